"""The search tools by request, over HTTP, and over shards."""

import json
import urllib.error
import urllib.request

import pytest

from lexspan import service

TEXTS = {"a": "hello world hello there hello", "b": "hello world world", "c": "quick brown fox hello", "d": "nothing here"}


@pytest.fixture(scope="module")
def whole(spark):
    return service.Collection(spark.createDataFrame(list(TEXTS.items()), "docno string, text string"))


def test_tools(whole):
    hits = whole.call("search_gcl", {"query": "(^ hello world)", "top_k": 2})
    assert [h["docid"] for h in hits["results"]] == ["a", "b"] and hits["truncated"]
    assert whole.call("count_matches", {"query": "hello"}) == {"count": 3}
    assert whole.call("get_document", {"docid": "c"}) == {"docid": "c", "contents": TEXTS["c"]}
    found = whole.call("cover_search", {"query": "(^ hello world)", "exclude": ["a"]})
    assert [(h["docid"], h["summary"]) for h in found["results"]] == [("b", TEXTS["b"])] and not found["truncated"]
    assert [h["docid"] for h in whole.call("tiered_query_search", {"tiers": ["(^ hello world)", "fox"]})["results"]] == ["a", "b", "c"]
    assert {h["docid"] for h in whole.call("multitext_tiered_search", {"program": 'x = "quick"\n@rank x'})["results"]} == {"c"}
    assert len(whole.call("search_text", {"query": "hello world"})["results"]) == 3
    assert whole.describe()["documents"] == 4 and whole.describe()["tokens"] == 14


@pytest.mark.parametrize(("tool", "request_", "status"), [("search_gcl", {}, 400), ("search_gcl", {"query": "(^ a"}, 400), ("search_text", {"query": "x", "top_k": 0}, 400), ("get_document", {"docid": "zz"}, 404), ("nothing", {}, 404)])
def test_refusals(whole, tool, request_, status):
    with pytest.raises(service.Refused) as e:
        whole.call(tool, request_)
    assert e.value.status == status


def test_budget_refuses(spark, whole):
    small = service.Collection(whole.docs, budget=150)
    with pytest.raises(service.Refused, match="hello 120, world 72") as e:
        small.call("search_gcl", {"query": "(^ hello world)"})
    assert e.value.status == 413 and small.call("count_matches", {"query": "world"}) == {"count": 2}


def test_shards_merge(spark, whole):
    part = lambda names: service.Collection(spark.createDataFrame([(n, TEXTS[n]) for n in names], "docno string, text string"))
    both, query = service.Shards([part("ac"), part("bd")]), {"query": "(^ hello world)"}
    assert both.call("search_gcl", query) == whole.call("search_gcl", query)
    assert both.call("count_matches", {"query": "hello"}) == {"count": 3} and both.call("get_document", {"docid": "b"})["docid"] == "b"
    assert both.describe()["documents"] == 4


def test_http():
    engine = service.Scripted([("search_text", {"results": [], "truncated": False})])
    server = service.serve(engine, port=0, token="t")
    url = f"http://127.0.0.1:{server.server_address[1]}"

    def ask(path, body=None, token="t"):
        request = urllib.request.Request(url + path, None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(request, timeout=10) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert ask("/healthz", token="no") == (200, {"ok": True})
    assert ask("/describe", token="no")[0] == 401
    assert ask("/tools/search_text", {"query": "x"}) == (200, {"results": [], "truncated": False})
    assert ask("/tools/search_text", {"query": "x"})[0] == 400 and ask("/nowhere")[0] == 404 and ask("/tools/x", [1])[0] == 400
    server.shutdown()
