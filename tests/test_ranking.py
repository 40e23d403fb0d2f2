"""Statistics, rankers and metrics with numbers worked out by hand."""

import itertools
import math
import random

import pytest

from lexspan.operators import evaluation as ev
from lexspan.operators import ranking as rk
from lexspan.operators import search as se
from lexspan.plans.engine import Engine

TEXTS = ["hello world hello there hello", "hello world world", "quick brown fox hello", "nothing here"]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


@pytest.fixture(scope="module")
def query(spark):
    return spark.createDataFrame([(0, "world", 1.0), (0, "quick", 2.0), (0, "hello", 1.0)], "topic long, term string, weight double")


def test_statistics(engine):
    total = rk.totals(engine.tokens).first()
    assert (total["items"], total["length"], total["vocab"]) == (4, 14, 8)
    df = {r.term: (r.df, r.cf) for r in rk.document_frequencies(rk.term_frequencies(engine.tokens)).collect()}
    assert df["hello"] == (3, 5) and df["world"] == (2, 3)


def test_bm25(engine, query):
    got = {r.doc_id: r.score for r in rk.bm25(engine.statistics(query), query).collect()}
    # world and hello are in half of the documents or more, so their weight is 0
    w = math.log((4 - 1 + 0.5) / 1.5)
    assert got == {2: pytest.approx(2 * w * 1 / (0.5 * (0.75 + 0.25 * 4 / 3.5) + 1))}


def test_lmd(engine, query):
    got = {r.doc_id: r.score for r in rk.lmd(engine.statistics(query), query, mu=10.0).collect()}
    want = math.log(10 + 3 * 14 / 5) - math.log(15) + math.log(10 + 14 / 3) - math.log(15)
    assert got[0] == pytest.approx(want)


def test_cover_density(engine):
    got = {r.doc_id: (r.score, r.p, r.q) for r in rk.cover_density(engine.gcl("(^ hello world)")).collect()}
    assert got[0] == (pytest.approx(2 / 43), 0, 1) and got[1] == (pytest.approx(1 / 43), 0, 1)


def test_icover_and_search(engine):
    rows = se.search_text(engine, "hello world", 10).collect()
    # "world" alone weighs ln(22 / 4), more than its cover with "hello": ln(22 / 4) + ln(22 / 6) - 2 ln 2
    assert [(r.doc_id, r.p, r.q) for r in rows] == [(0, 1, 1), (1, 1, 1), (2, 3, 3)]
    assert {r.doc_id for r in se.tiered(engine, ["(^ hello world)", "fox"], 10).collect()} == {0, 1, 2}
    marked = {r.doc_id: r.snippet for r in se.highlighted(engine, "(... hello world)", 5).collect()}
    assert "<cover>hello world</cover>" in marked[1]
    said = {r.doc_id: r.summary for r in se.summaries(engine, "(^ hello world)", 5, window=2).collect()}
    assert said[1].startswith("hello world")


def test_covers_and_single_terms_by_score(spark):
    """Against all covers of all places: a rare term alone may outdo a long cover of common ones."""
    rng = random.Random(4)
    docs = {k: [rng.choice("abcxyz") for _ in range(rng.randint(1, 30))] + (["rare"] if k == 3 else []) for k in range(40)}
    weights = {"a": 1.5, "b": 2.0, "c": 3.0, "rare": 9.0}
    tokens = spark.createDataFrame([(k, w, p) for k, ws in docs.items() for p, w in enumerate(ws)], "doc_id long, term string, pos long")
    total = 1000.0
    counts = {t: total / math.exp(w) - 1 for t, w in weights.items()}
    want = {}
    for k, ws in docs.items():
        for p, q in itertools.combinations_with_replacement(range(len(ws)), 2):
            seen = {w for w in ws[p : q + 1] if w in weights}
            score = sum(weights[t] for t in seen) - (len(seen) * math.log(q - p + 1) if len(seen) > 1 else 0)
            if seen and score > 0 and (len(seen) > 1 or p == q):
                want[k] = max(want.get(k, 0), score)
    got = {r.doc_id: r.score for r in rk.icover(tokens, list(weights), total, 0.0, counts, 100).collect()}
    assert got == pytest.approx(want, abs=1e-6) and max(got, key=got.get) == 3


def test_pipeline(spark, engine):
    topics = spark.createDataFrame([(7, "the quick foxes"), (8, "the of")], "item_id long, text string")
    with pytest.raises(ValueError, match="unknown stage"):
        se.Pipeline("bm25 nothing")
    rows = se.Pipeline("stop bm25:depth=2 rsj bm25").run(engine, topics).collect()
    assert rows[0].topic == 7 and rows[0].doc_id == 2
    assert {(r.topic, r.term) for r in se.stopped(rk.query_terms(topics)).collect()} == {(7, "quick"), (7, "foxes"), (8, "the"), (8, "of")}


@pytest.fixture(scope="module")
def run(spark):
    run = spark.createDataFrame([(1, d, r, 16) for r, d in enumerate([10, 11, 12, 13], 1)], "topic long, doc_id long, rank long, len long")
    qrels = spark.createDataFrame([(1, 11, 1.0), (1, 13, 1.0), (1, 99, 1.0), (1, 10, 0.0)], "topic long, doc_id long, grade double")
    return run, qrels


def test_metrics(run):
    run, qrels = run
    p = ev.precision_metrics(run, qrels).first()
    assert (p["ap"], p["rr"], p["p05"], p["rel_ret"]) == (pytest.approx((1 / 2 + 2 / 4) / 3), 0.5, 0.4, 2)
    g = ev.ndcg_metrics(run, qrels).first()
    dcg = math.log(2) * (1 / math.log(3) + 1 / math.log(5))
    assert g["dcg"] == pytest.approx(dcg)
    assert g["ndcg"] == pytest.approx(dcg / (math.log(2) * sum(1 / math.log(r + 1) for r in (1, 2, 3))))
    r = ev.rbp_metrics(run, qrels).first()
    assert r["rbp50"] == pytest.approx(0.5 * (0.5 + 0.125))
    bad, good = 4.4 + (0.018 * 16 + 7.8) * 0.39, 4.4 + (0.018 * 16 + 7.8) * 0.64
    decay = lambda s: math.exp(-s * math.log(2) / 224)
    assert ev.time_biased_gain(run, qrels).first()["tbg"] == pytest.approx(0.64 * 0.77 * (decay(bad) + decay(2 * bad + good)))


def test_difference_of_a_run_with_itself(run):
    run, _ = run
    found = ev.effectiveness_difference(run, run).first()
    assert found["med_dcg"] == pytest.approx(0) and found["med_rbp50"] == pytest.approx(0)


def test_tuning(spark):
    from lexspan.operators import tuning

    assert tuning.parameter("bm25", "b", {"b": 0.5}) == 0.5 and tuning.parameter("lmd", "mu", {}) == 2000.0
    assert len(list(tuning.grid(k1=[1.0, 2.0], b=[0.1, 0.2, 0.3]))) == 6
    assert all(1 <= d["mu"] <= 100 for d in tuning.draws(5, 1, mu=(1, 100, True)))
    values = spark.createDataFrame([(t, q, 1.0 * t + q % 3) for t in range(2) for q in range(12)], "trial int, topic int, value double")
    rows = {r.trial: r for r in tuning.bootstrap(values, samples=50).collect()}
    assert rows[1].wins == 50 and rows[0].wins == 0
    docs = spark.range(30).withColumnRenamed("id", "doc_id")
    one, two = (tuning.random_ranking(docs, 5, s).collect() for s in (1, 2))
    assert len(one) == 5 and one != two and one == tuning.random_ranking(docs.repartition(3), 5, 1).collect()


def test_statistics_by_recipe(spark):
    from lexspan.operators import statistics as sl

    texts = ["one fox two", "fox fox three four", "nothing here", "one two three four five six"]
    notes = [(":title:", 0, 0, 1, 0.0), (":body:", 0, 1, 2, 0.0), (":title:", 1, 0, 0, 0.0), (":body:", 1, 1, 3, 0.0), ("@tf-idf:tf:fox", 1, 0, 0, 7.0)]
    engine = Engine(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(notes, "feature string, doc_id long, p long, q long, v double"))
    query = spark.createDataFrame([(0, "fox", 1.0), (0, "two", 1.0)], "topic long, term string, weight double")

    def told(stats):
        tf, terms = stats
        return {(r.term, r.doc_id): (r.tf, r.len) for r in tf.collect()}, {r.term: (r.df, r.cf, r["items"]) for r in terms.collect()}

    assert told(sl.select(engine, {"statistics": "df"}, query)) == ({("fox", 0): (1, 3), ("fox", 1): (2, 4), ("two", 0): (1, 3), ("two", 3): (1, 6)}, {"fox": (2, 3, 4), "two": (2, 2, 4)})
    tf, df = told(sl.select(engine, {"container": "(... one two)"}, query))
    assert {(t, d[0], d[1], d[2]): n for (t, d), n in tf.items()} == {("fox", 0, 0, 2): (1, 3), ("two", 0, 0, 2): (1, 3), ("two", 3, 0, 1): (1, 2)} and df == {"fox": (1, 1, 2), "two": (2, 2, 2)}
    assert told(sl.select(engine, {"container": ":item"}, query))[1] == {"fox": (2, 3, 4), "two": (2, 2, 4)}
    tf, _ = told(sl.select(engine, {}, query, "field", ":title:=2 :body:=0.5"))
    # place 1 of the first document stands in both fields
    assert tf == {("fox", 0): (2.5, 3), ("two", 0): (0.5, 3), ("fox", 1): (2.5, 4)}
    assert told(sl.select(engine, {"foraged": "yes"}, query))[0] == {("fox", 1): (7.0, 4)}
    for wrong in (({}, "", ""), ({}, "other", ""), ({}, "field", "title"), ({}, "field", "")):
        with pytest.raises(sl.NoStatistics):
            sl.select(engine, wrong[0], query, wrong[1], wrong[2])
    assert rk.bm25(sl.select(engine, {"container": ":item"}, spark.createDataFrame([(0, "one", 1.0)], query.schema)), spark.createDataFrame([(0, "six", 1.0)], query.schema)).count() == 0
