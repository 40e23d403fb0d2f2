"""Formats, transactions, snapshots, erasure and streams."""

import gzip
import json

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.sources import ingest as src
from lexspan.streaming import store as st


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "n long, value string")


def test_json_paths(spark):
    value = {"ppu": -0.55, "ok": True, "none": None, "batters": [{"type": "a"}, "b"]}
    rows = {(r.path, r.v if r.v == r.v else None, r.said) for r in src.json_paths(lines(spark, json.dumps(value)), "n", "value").collect()}
    assert (":ppu:", -0.55, "-0.550000") in rows and (":batters:", 2.0, "") in rows
    assert (":batters:[0]:type:", 0.0, "a") in rows and (":none:", None, "null") in rows and ("type:", 0.0, "") in rows
    bad = lines(spark, "{}", "no json", None)
    assert src.json_paths(bad, "n", "value", strict=False).count() == 1
    with pytest.raises(PythonException):
        src.json_paths(bad, "n", "value").count()


def test_jsonl(spark, tmp_path):
    rows = ['{"docid":"a","contents":"quick fox"}', "", "broken", '{"docid":"b"}', '{"docid":"c","contents":"..."}', '{"docid":"d","contents":"x"}']
    (tmp_path / "x.jsonl").write_text("\n".join(rows) + "\n")
    with gzip.open(tmp_path / "y.jsonl.gz", "wt") as f:
        f.write("\n".join(rows) + "\n")
    found = src.jsonl_documents(src.read_lines(spark, str(tmp_path)))
    assert sorted(r.docno for r in found.collect()) == ["a", "a", "d", "d"]
    with pytest.raises(Exception, match="bad line"):
        src.jsonl_documents(lines(spark, *rows), strict=True).collect()


def test_values_and_lines(spark):
    rows = {(r.id, r.feature, r.said) for r in src.tsv_columns(lines(spark, "Pig\t\tMud bath", "x"), "n", "value").collect()}
    assert rows == {(0, ":0:", "Pig"), (0, ":1:", ""), (0, ":2:", "Mud bath"), (1, ":0:", "x")}
    assert [r.said for r in src.tsv_columns(lines(spark, " a  b "), "n", "value", "").collect()] == ["a", "b"]
    assert [tuple(r) for r in src.query_lines(lines(spark, "1\tred fox", "2 blue fox")).collect()] == [("1", "red fox"), ("2", "blue fox")]
    assert [tuple(r) for r in src.qrels_lines(lines(spark, "1 Q0 d -2", "x")).collect()] == [("1", "d", 0.0)]
    trec = src.trec_documents(lines(spark, "<DOC>\n<DOCNO> a1 </DOCNO>\nbody\n</DOC>\n<DOC><DOCNO>b</DOCNO></DOC>")).collect()
    assert [tuple(r) for r in trec] == [("a1", "body"), ("b", "")]
    vector = src.sparse_vectors(lines(spark, '{"docid":"d","splade_vector":{"x":3,"y":0,"z":1.5}}')).collect()
    assert [tuple(r) for r in vector] == [("d", "splade:x", 3)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    found = {r.feature: r.said for r in src.file_features(src.read_files(spark, str(tmp_path))).collect()}
    assert found["content:"] == "one\ntwo\n" and found["filename:"].endswith("a.txt")
    assert src.not_yet(src.read_files(spark, str(tmp_path)), spark.createDataFrame([(f" {found['filename:']} ",)], "path string")).count() == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "McDonald ate <p class='x'>R&amp;D</p>", "Größe 漢字 ☂ x")], "doc_id long, text string, wide string")
    row = docs.select(F.transform(tx.ascii_words(F.lit("McDonald Ate")), tx.index_terms).alias("t"), tx.xml_words(F.col("text")).alias("x"), tx.utf8_words(F.col("wide")).alias("u"), tx.truncated(F.lit("aé漢"), 4).alias("s")).first()
    assert row.t == [["McDonald", "mcdonald"], ["ate"]]
    assert row.x == ["McDonald", "ate", "<p>", "R", "D", "</p>"]
    assert row.u == ["größe", "漢", "字", "☂", "x"] and row.s == "aé"


def annotated(spark, *rows):
    return spark.createDataFrame(list(rows), "feature string, doc_id long, p long, q long, v double")


def test_transactions(spark, tmp_path):
    store = st.Store(spark, f"file://{tmp_path}/store")
    first = store.transaction()
    first.annotate(annotated(spark, ("a", 1, 0, 2, 1.0), ("a", 1, 5, 4, 1.0), ("", 1, 0, 0, 1.0)))
    with pytest.raises(RuntimeError):
        first.commit()
    assert first.ready() and store.read().count() == 0
    n = first.commit()
    second = store.transaction()
    second.annotate(annotated(spark, ("a", 1, 1, 2, 2.0), ("b", 2, 0, 0, 5.0)))
    second.erase(spark.createDataFrame([(2, 0, 9)], "doc_id long, p long, q long"))
    second.ready()
    second.commit()
    assert [(r.feature, r.p) for r in store.read(n).collect()] == [("a", 0)]
    assert sorted((r.feature, r.doc_id, r.p) for r in store.read().collect()) == [("a", 1, 0), ("a", 1, 1)]
    assert [(r.p, r.v) for r in st.latest(store.read()).collect()] == [(1, 2.0)]
    gone = store.transaction()
    gone.annotate(annotated(spark, ("c", 3, 0, 0, 1.0)))
    gone.ready()
    gone.abort()
    with pytest.raises(RuntimeError):
        gone.commit()
    assert store.read().where("feature = 'c'").count() == 0


def test_lists(spark, tmp_path):
    """A text is stored as one row for each of its words that differ, read back as one for each place; no exchange puts all rows of a transaction together."""
    texts = {1: "One two, one", 2: None, 3: "", 4: "two K\u212a \u0130x", 5: ", ,"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").union(spark.sql("SELECT NULL, 'one one'"))
    plain = lambda rows: sorted((str(tuple(r)) for r in rows.select("feature", "doc_id", "p", "q", "v").collect()))
    store = st.Store(spark, str(tmp_path / "store"))
    assert store.lists().count() == store.read().count() == 0
    t = store.transaction()
    t.annotate_lists(st.token_lists(docs))
    t.annotate_lists(spark.createDataFrame([("", 1, [0], [1], [0.0]), (None, 1, [0], None, None), ("x", 1, [2], [1], [0.0]), ("x", 2, [], None, None)], st.LISTS))
    t.annotate_lists(spark.createDataFrame([("y", 1, [2, 3, 4, None], [1, 5, 4, 1], [1.0, 2.0, 3.0, 4.0]), ("y", 2, [7], [8], None), ("y", 3, [7, 8], None, [5.0, 6.0])], st.LISTS))
    t.ready()
    t.commit()
    own = annotated(spark, ("y", 1, 3, 5, 2.0), ("y", 1, 4, 4, 3.0), ("y", 2, 7, 8, 0.0), ("y", 3, 7, 7, 5.0), ("y", 3, 8, 8, 6.0))
    want = plain(st.token_rows(docs).unionByName(own))
    assert plain(store.read()) == want and len(want) == 3 + 4 + 2 + 3 + 5
    written = spark.read.parquet(str(tmp_path / "store" / "data"))
    assert written.count() == store.lists().count() == 2 + 4 + 1 + 3 + 3
    # however large a transaction is, its rows aren't dealt by its id
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in store.read()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    store.compact()
    assert plain(store.read()) == plain(st.single(store.lists())) == want
    t = store.transaction()
    t.erase(spark.createDataFrame([(1, 0, 1)], "doc_id long, p long, q long"))
    t.ready()
    t.commit()
    left = {(r.feature, r.doc_id): list(zip(r.p, r.q, r.v, strict=True)) for r in store.lists().collect()}
    assert left["one", 1] == [(2, 2, 0.0)] and ("two", 1) not in left and left[":item", 1] == [(0, 2, 0.0)]


def test_stream(spark, tmp_path):
    store = st.Store(spark, f"file://{tmp_path}/store")
    docs = spark.createDataFrame([(1, "one two"), (2, "two")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    query = st.append_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert store.read().where("feature = 'two'").count() == 2 and store.read().where("feature = ':item'").count() == 2


def test_collections_and_text(spark):
    rows = src.collection(lines(spark, '{"pid":"p1","passage":"a \\"b\\""}', '{"passage":"x"}'), "passages_v2").collect()
    assert sorted(tuple(r) for r in rows) == [("p1", ":passage:", 'a "b"'), ("p1", ":pid:", "p1")]
    assert [tuple(r) for r in src.passage_lines(lines(spark, "7\ta\tb", "x")).collect()] == [("7", "a\tb")]
    assert spark.range(1).select(src.json_text(F.lit('say "hi"'))).first()[0] == '"say \\"hi\\""'
    assert spark.range(1).select(tx.okay(F.lit("Yes")), tx.okay(F.lit("no"))).first()[:] == (True, False)


def test_command_line(spark, tmp_path):
    from lexspan.cli import answer, main

    (tmp_path / "x.jsonl").write_text('{"docid":"a","contents":"quick brown fox"}\n{"docid":"b","contents":"fox"}\n')
    path = str(tmp_path / "x.jsonl")
    assert answer(spark, "count", path, "(^ quick fox)") == {"count": 1}
    assert answer(spark, "describe", path, "") == {"documents": 2, "tokens": 4}
    assert answer(spark, "get", path, "b") == {"docno": "b", "text": "fox"}
    assert [r["docno"] for r in answer(spark, "gcl", path, "fox")["results"]] == ["a", "b"]
    assert answer(spark, "cover", path, "(... quick fox)")["results"][0]["summary"] == "quick brown fox"
    assert main(["nothing"]) == 1


def test_two_writers_and_compaction(spark, tmp_path):
    """Writers that commit at the same time get numbers of their own, and nothing is lost; compaction changes no result."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "shared")
    st.Store(spark, path)

    def writer(name):
        store, numbers = st.Store(spark, path), []
        for k in range(6):
            t = store.transaction()
            t.annotate(spark.createDataFrame([(name, k, 0, 1, float(k))], st.PLAIN))
            t.ready()
            numbers.append(t.commit())
        return numbers

    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(writer, ["a", "b", "c"]))
    assert sorted(n for own in numbers for n in own) == list(range(1, 19)) and all(own == sorted(own) for own in numbers)
    store = st.Store(spark, path)
    rows = lambda upto=None: sorted(tuple(r) for r in store.read(upto).collect())
    before, early = rows(), rows(7)
    assert len(before) == 18 and len(early) == 7
    assert store.compact() == 19 and rows() == before and rows(7) == early
    t, u = store.transaction(), store.transaction()
    t.erase(spark.createDataFrame([(0, 0, 5)], "doc_id long, p long, q long"))
    u.annotate(spark.createDataFrame([("d", 0, 0, 1, 9.0)], st.PLAIN))
    assert store.commit_all([t, u]) == 20
    assert {r[0] for r in rows() if r[1] == 0} == set() and len(rows()) == 15 and rows(19) == before
    assert store.compact() == 21 and len(rows()) == 15 and rows(18) == before


def test_many_commits(spark, tmp_path):
    """A plan of one size whatever the number of commits."""
    store = st.Store(spark, str(tmp_path / "many"))
    t = store.transaction()
    t.annotate(spark.createDataFrame([("a", 1, 0, 0, 0.0)], st.PLAIN))
    t.ready()
    for _ in range(1000):
        store.publish({"ids": []})
    t.commit()
    rows = store.read()
    assert rows.collect()[0].snap == 1001 and rows._jdf.queryExecution().optimizedPlan().toString().count("parquet") < 6


def test_many_erasures_by_snapshot(spark):
    """Against every row compared with every erasure: only erasures not before a row count, and only if one holds all of it."""
    import random

    from lexspan.streaming import store as st

    rng = random.Random(3)
    for snaps in (1, 2, 3, 7):
        rows, erased = [], []
        for k in range(400):
            p = rng.randint(0, 60)
            q = p + rng.choice([0, 1, 3, 9])
            feature = "" if k % 5 == 0 else rng.choice("ab")
            rows.append((feature, rng.choice([1, 2, None]), p, q + (6 if not feature else 0), float(k), rng.randint(1, snaps)))
        erased = [r for r in rows if not r[0]]
        gone = lambda r, e: r[1] is not None and r[1] == e[1] and e[2] <= r[2] and r[3] <= e[3] and r[5] <= e[5]
        want = {r[4] for r in rows if r[0] and not any(gone(r, e) for e in erased)}
        got = st.visible(spark.createDataFrame([r for r in rows if r[1] is not None], st.ROWS))
        assert {r.v for r in got.collect()} == {v for v in want if rows[int(v)][1] is not None}
        assert got.columns == ["feature", "doc_id", "p", "q", "v", "snap"]


def test_one_document_with_many_erasures(spark, tmp_path):
    from lexspan.streaming import store as st

    store = st.Store(spark, str(tmp_path / "store"))
    spans = spark.range(2000).selectExpr("'x' feature", "1L doc_id", "id p", "id q", "0.0D v")
    for part in range(3):
        t = store.transaction()
        t.annotate(spans)
        t.erase(spark.range(part * 200, part * 200 + 200).selectExpr("1L doc_id", "id * 3 p", "id * 3 + 1 q"))
        t.ready()
        t.commit()
    left = store.read().groupBy("snap").count().orderBy("snap").collect()
    # the first part loses what all three erase, the last only what its own does
    assert [r["count"] for r in left] == [2000 - 1200, 2000 - 800, 2000 - 400]
    store.compact()
    assert store.read().count() == 6000 - 2400


def test_tallies_of_pieces(spark, monkeypatch):
    """A piece of many documents gives a row for each of its different words and one for its totals; pieces and empty texts add up."""
    from collections import Counter

    from lexspan.streaming import statistics as sm

    texts = ["One two, ONE", None, "", ",", "two \u212a9", "three"] * 50
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, tx.tallies(docs).collect())) == [("", 150, 300), ("k9", 50, 50), ("one", 50, 100), ("three", 50, 50), ("two", 100, 100)]
    assert sorted(map(tuple, sm.term_counts(docs.repartition(7)).collect())) == sorted(map(tuple, tx.tallies(docs).collect()))
    # rows that are larger than a piece, and pieces of several rows
    monkeypatch.setattr(tx, "CUT", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([t if t is None else t.lower() for t in texts[:12]])], names=["text"])
    found, cf = list(tx._tallied([batch, batch.slice(1, 3)])), Counter()
    for part in found:
        cf.update({r["term"]: r["cf"] for r in part.to_pylist()})
    assert len(found) > 2 and cf == {"": 12, "one": 4, "two": 4, "k9": 2, "three": 2}


def test_statistics_follow_a_stream(spark, tmp_path):
    """Files arrive one after another; after each, the stream's counts are those of a batch over all of them."""
    import random
    from collections import Counter

    from lexspan.streaming import statistics as sm

    rng = random.Random(2)
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(source)
    texts = []
    for part in range(3):
        new = [" ".join(rng.choice("Aa b c d e f".split()) for _ in range(rng.randint(0, 9))) for _ in range(20)] + [None, "same same", "same same"]
        texts += new
        spark.createDataFrame([(part * 100 + k, t) for k, t in enumerate(new)], "doc_id long, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        sm.keep_statistics(stream, kept, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
        words = [(t or "").lower().split() for t in texts]
        df, cf = Counter(w for ws in words for w in set(ws)), Counter(w for ws in words for w in ws)
        rows = sm.statistics_now(spark, kept).collect()
        assert {r.term: (r.df, r.cf) for r in rows} == {w: (df[w], cf[w]) for w in df}
        assert {(r["items"], r["length"]) for r in rows} == {(sum(map(bool, words)), sum(map(len, words)))}
        assert {r.term: (r.df, r.cf) for r in sm.term_counts(spark.read.parquet(source)).collect() if r.term} == {w: (df[w], cf[w]) for w in df}
