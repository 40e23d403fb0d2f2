"""The stored index against brute force; what a search reads of it."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexspan.functions.text import porter
from lexspan.operators import ranking as rk
from lexspan.operators import search as se
from lexspan.operators import tuning
from lexspan.plans.engine import Engine, StoredEngine
from lexspan.sources.postings import Postings

WORDS = ["run", "running", "runs", "fox", "foxes", "the", "quick", "Brown", "x1", "jumped"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    rows = [(k, " ".join([*(rng.choice(WORDS) for _ in range(rng.randint(0, 40))), f"rare{rng.randint(0, 20)}", rng.choice(["walked", "walks", "sleeping", "dreams", "b", "c", "d", "e"])])) for k in range(60)]
    return [*rows, (60, None), (61, ""), (62, "the " * 500), (3, "a second text of one id"), (None, "no id at all")]


@pytest.fixture(scope="module")
def path(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(path)
    return path


@pytest.fixture(scope="module")
def index(spark, path):
    return Postings.stored(spark, path)


def test_tables(index, texts):
    tf, df, length = Counter(), Counter(), Counter()
    places = []
    for k, text in texts:
        words = re.findall("[a-z0-9]+", (text or "").lower())
        places += [(w, k, n) for n, w in enumerate(words)]
        tf.update((w, k) for w in words)
        length[k] += len(words)
    df = Counter(w for w, _ in tf)
    assert Counter((r.term, r.doc_id, r.pos) for r in index.tokens.collect()) == Counter(places)
    assert {(r.term, r.doc_id): (r.tf, r.len) for r in index.postings.collect()} == {(w, k): (n, length[k]) for (w, k), n in tf.items()}
    cf = Counter()
    for (w, _), n in tf.items():
        cf[w] += n
    assert {r.term: (r.df, r.cf) for r in index.terms.collect()} == {w: (df[w], cf[w]) for w in df}
    assert {r.term: r.stem for r in index.stems.collect()} == {w: porter(w) for w in df if porter(w) != w}
    assert (index.items, index.length, index.vocab) == (sum(n > 0 for n in length.values()), sum(length.values()), len(df))


def test_a_list_is_read_from_one_folder(index):
    plan = index.places(["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan and "EqualTo(term,fox)" in plan
    assert len({f.split("slot=")[1].split("/")[0] for f in index.tokens.where(F.col("term") == "fox").select("slot").distinct().inputFiles()}) >= 1
    assert index.tokens.where(F.col("term") == "fox").select("slot").distinct().count() == 1


def test_changed_tables_get_new_indexes(spark, path, index, tmp_path):
    assert Postings.stored(spark, path).path == index.path
    other = str(tmp_path / "other.parquet")
    spark.createDataFrame([(1, "one two")], "doc_id long, text string").write.parquet(other)
    first = Postings.stored(spark, other)
    spark.createDataFrame([(2, "three")], "doc_id long, text string").write.mode("append").parquet(other)
    second = Postings.stored(spark, other)
    assert (first.items, second.items) == (1, 2) and first.path != second.path
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none.parquet"))
    none = Postings.stored(spark, str(tmp_path / "none.parquet"))
    assert (none.items, none.length, none.vocab) == (0, 0, 0) and none.places(["x"]).count() == 0


@pytest.fixture(scope="module")
def engines(spark, path, index):
    docs = spark.read.parquet(path).where("doc_id is not null and doc_id <> 3")
    plain = str(path) + "-plain"
    docs.write.mode("overwrite").parquet(plain)
    docs = spark.read.parquet(plain)
    return Engine(docs, stem=True), StoredEngine(Postings.stored(spark, plain), docs, stem=True)


@pytest.mark.parametrize("expr", ["fox", "(^ fox running)", "(+ quick fox fox)", "(... the quick)", '"the quick"', '"the the the"', "(<< fox (... the quick))", "(!> (... the quick) fox)", "(^ (+ fox \"the quick\") run)", "(^ porter:fox the)", "(>> :item fox)", "(+ (>> (% (... the fox)) run) (^ (... the fox) quick))"])
def test_lists_are_alike(engines, expr):
    a, b = ({tuple(r) for r in e.gcl(expr).select("doc_id", "p", "q").collect()} for e in engines)
    assert a == b and a


def test_rankings_are_alike(spark, engines):
    topics = spark.createDataFrame([(1, "foxes rare1 walking"), (2, "the quick rare2 rare3 sleeps"), (3, "nowhere")], "item_id long, text string")
    for line in ("bm25:depth=9", "lmd:mu=10", "stop stem bm25:depth=5 rsj:expansions=4 bm25:depth=9", "bm25:depth=4 kld bm25"):
        a, b = ({(r.topic, r.doc_id, r["rank"]): r.score for r in se.Pipeline(line).run(e, topics).collect()} for e in engines)
        assert a == pytest.approx(b, abs=1e-6) and a, line
    query = rk.query_terms(topics)
    settings = [{"k1": 0.5, "b": 0.25}, {"k1": 1.2, "b": 0.9}]
    grid = tuning.bm25_trials(engines[1].statistics(query), query, settings, 5).collect()
    for n, s in enumerate(settings):
        one = {(r.topic, r.doc_id): r["rank"] for r in rk.ranked(rk.bm25(engines[0].statistics(query), query, **s), 5).collect()}
        assert {(r.topic, r.doc_id): r["rank"] for r in grid if r.trial == n} == one


def test_shared_list_is_made_once(engines):
    plan = engines[1].gcl("(+ (>> (... the fox) run) (^ (... the fox) quick))")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 3, "three operators above; the list below two of them was written"
    assert {f.rsplit("/", 2)[1].split("-")[0] for f in engines[1].shared(engines[1].gcl("fox")).inputFiles()} == {"list"}


def test_containers(spark):
    rng = random.Random(5)
    covers, boxes = [], []
    for doc in range(12):
        p = q = 0
        for _ in range(rng.randint(0, 15)):
            p, q = p + rng.randint(1, 4), q + rng.randint(1, 4)
            q = max(p, q)
            if not covers or covers[-1][0] != doc or (covers[-1][1] < p and covers[-1][2] < q):
                covers.append((doc, p, q, 0.0))
        for _ in range(8):
            a = rng.randint(0, 40)
            boxes.append((doc, a, a + rng.choice([0, 5, 20, 60])))
        boxes.append(boxes[-1])
    c, b = spark.createDataFrame(covers, "doc_id long, p long, q long, v double"), spark.createDataFrame(boxes, "doc_id long, p long, q long")
    want = {(d, x, y, p, q) for d, x, y in boxes for e, p, q, _ in covers if d == e and x <= p and q <= y}
    assert {tuple(r)[:5] for r in rk.inside(c, b).collect()} == want and want
    dense = defaultdict(float)
    for d, x, y, p, q in want:
        dense[d, x, y] += 1 / (42 + q - p)
    assert {(r.doc_id, r.container_p, r.container_q): r.score for r in rk.cover_density(c, containers=b).collect()} == pytest.approx(dict(dense))
    near = {(d, p, q): min(((y, -x) for e, x, y in boxes if e == d and y >= q), default=None) for d, p, q, _ in covers}
    got = {(r.doc_id, r.p, r.q): (r.container_q, -r.container_p) if r.container_q is not None else None for r in rk.attached(c, b).collect()}
    assert got == near


def test_tiers_stop_early(engines, monkeypatch):
    asked = []
    one = Engine.gcl
    monkeypatch.setattr(Engine, "gcl", lambda self, expr: asked.append(str(expr)) or one(self, expr))
    found = se.tiered(engines[1], ["fox", "the", "run"], 3).collect()
    assert asked == ["fox"] and [r.tier for r in found] == [0, 0, 0]
    every = se.tiered(engines[1], ["(^ fox x1)", "the", "run"], 1000)
    assert {r.doc_id for r in every.collect()} == {r.doc_id for e in ("(^ fox x1)", "the", "run") for r in engines[0].gcl(e).collect()}


def test_feedback_across_collections(spark, engines):
    other = Engine(spark.createDataFrame([(100, "fox jumped"), (101, "nothing"), (102, "running runs")], "doc_id long, text string"), stem=True)
    query = rk.query_terms(spark.createDataFrame([(1, "quick fox")], "item_id long, text string"))
    for stem in (False, True):
        found = se.cross_feedback(engines[1], other, query, stem=stem, most=10).collect()
        assert all(r.topic == 1 and r.doc_id in (100, 102) for r in found)
