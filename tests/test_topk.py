"""The best of each topic against rankings of all pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspan.operators import ranking as rk
from lexspan.operators import topk
from lexspan.operators import tuning
from lexspan.plans.engine import Engine


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randint(1, 25)))) for k in range(120)]
    docs += [(200 + k, "ax by cz copy copy") for k in range(90)]  # many copies, so that ties reach over pieces
    query = [(t, rng.choice("abcdefghij") + rng.choice("xyz"), float(rng.randint(1, 3))) for t in range(9) for _ in range(5)] + [(t, "copy", 2.0) for t in (3, 4)] + [(77, "nowhere", 1.0)]
    query = spark.createDataFrame(list({(t, w): (t, w, x) for t, w, x in query}.values()), "topic long, term string, weight double")
    return Engine(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).statistics(query), query


def rows(ranking):
    return {(r.topic, r["rank"]): (r.doc_id, r.score) for r in ranking.collect()}


@pytest.mark.parametrize("piece", [1, 40, 2_000_000])
def test_best_is_the_ranking_of_all_pairs(case, piece, monkeypatch):
    monkeypatch.setattr(topk, "PIECE", piece)
    stats, query = case
    for depth in (1, 7, 500):
        assert rows(rk.best_bm25(stats, query, depth)) == rows(rk.ranked(rk.bm25(stats, query), depth))
        assert rows(rk.best_lmd(stats, query, depth, 10.0)) == rows(rk.ranked(rk.lmd(stats, query, 10.0), depth))
    settings = [{"k1": 0.5, "b": 0.25}, {"k1": 1.2, "b": 0.9}]
    grid = tuning.bm25_trials(stats, query, settings, 6)
    for n, s in enumerate(settings):
        assert rows(grid.where(F.col("trial") == n)) == rows(rk.ranked(rk.bm25(stats, query, **s), 6))


def test_pairs_are_never_shuffled(case):
    """Before, each pair of a topic and a document was a row of an exchange."""
    stats, query = case
    plan = rk.best_bm25(stats, query, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [topic" not in plan and "MapInArrow" in plan


def test_changes_of_ids():
    assert topk.changes(pa.array([None, None, 1, 1, 2, None])).tolist() == [True, False, True, False, True, True]
    spans = pa.array([{"d": 1, "p": 2}, {"d": 1, "p": 2}, {"d": 1, "p": 3}, {"d": 2, "p": 3}])
    assert topk.changes(spans).tolist() == [True, False, True, True]


def test_all_products_of_vectors(spark, tmp_path, monkeypatch):
    """Before, the query kept the hundred best of a topic, and shuffled every pair of vectors."""
    import duckdb

    from lexspan import catalog, registry  # noqa: F401

    rng = random.Random(1)
    vectors = [(k, [rng.uniform(-0.3, 1) for _ in range(6)]) for k in range(260)] + [(300, None), (301, [0.0] * 6), (302, [1.0, None, -2.0]), (303, [float("inf"), -1.0]), (None, [1.0] * 6)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    spark.createDataFrame([*vectors, (20, [0.5] * 6)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    monkeypatch.setattr(rk, "BLOCK", 50)
    for name in ("a", "b"):
        duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/{name}/embeddings.parquet/*.parquet'")
        want = {r[:2]: r[2] for r in duckdb.sql(registry.oracle_sql()["dot_product"]).fetchall()}
        found = registry.queries()["dot_product"](spark, f"{tmp_path}/{name}")
        assert {(r.topic, r.doc_id): r.score for r in found.collect()} == pytest.approx(want, abs=2e-5, nan_ok=True) and len(want) > 100 * 13


@pytest.mark.parametrize("cells", [1, 2_000_000])
def test_covers_of_many_groups(cells, monkeypatch):
    """Against all intervals between places; before, each place of a group was a step of an expression of the plan."""
    import itertools
    import math

    import numpy as np

    monkeypatch.setattr(topk, "CELLS", cells)
    rng = random.Random(9)
    weight = [0.7, 2.0, 3.5, 5.0]
    spots = [(g, p, rng.randrange(4)) for g in range(60) for p in sorted(rng.sample(range(40), rng.randint(1, 12)))]
    rng.shuffle(spots)
    g, p, t = (np.array(x, np.int64) for x in zip(*spots, strict=True))
    score, first, last = topk.covers(g, p, t, np.array(weight)[t])
    for k in range(60):
        own = sorted((p, t) for g, p, t in spots if g == k)
        found = []
        for a, b in itertools.combinations_with_replacement(range(len(own)), 2):
            seen = {t for _, t in own[a : b + 1]}
            s = sum(weight[t] for t in seen) - (len(seen) * math.log(own[b][0] - own[a][0] + 1) if len(seen) > 1 else 0)
            found += [(-round(s, 9), own[a][0], own[b][0])] if a == b or (len(seen) > 1 and s > 0) else []
        assert (score[k], first[k], last[k]) == pytest.approx((-min(found)[0], *min(found)[1:]), abs=1e-8)


def test_word_lists_need_no_exchange(spark):
    """Before, every word of every document was a row of an exchange by document and word."""
    import re
    from collections import Counter

    from lexspan.functions import text as tx

    texts = [(1, "One two one, TWO! é x1"), (2, None), (3, ""), (4, "..."), (5, "a " * 3000 + "Ünd b"), (None, "no id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = Counter((k, w) for k, t in texts for w in re.findall("[a-z0-9]+", (t or "").lower()))
    assert {(r.doc_id, r.term): r.tf for r in tx.frequencies(docs).collect()} == want
    assert "Exchange" not in tx.frequencies(docs)._jdf.queryExecution().executedPlan().toString()
    twice = docs.unionByName(docs)
    assert {(r.doc_id, r.term): r.tf for r in tx.frequencies(twice).collect()} == {k: 2 * n for k, n in want.items()}
    lists = {(r.doc_id, r.term): (r.len, r.places) for r in tx.word_lists(docs).collect()}
    assert lists[1, "two"] == (5, [1, 3]) and lists[5, "a"][1] == list(range(3000))


def test_covers_that_reach_a_score_are_the_same():
    """With a score to reach, every group that reaches it has the same cover, and the others stay below."""
    import numpy as np

    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 300, 6000))
    pos, term = rng.permutation(40_000)[:6000] % 400, rng.integers(0, 12, 6000)
    keep = np.unique(np.stack([group, pos]), axis=1, return_index=True)[1]
    group, pos, term = np.unique(group[keep], return_inverse=True)[1], pos[keep], term[keep]
    w = rng.uniform(0.5, 12, 12)[term]
    score, p, q = topk.covers(group, pos, term, w)
    least = np.full(len(score), np.sort(score)[-40])
    again = topk.covers(group, pos, term, w, least)
    high = score >= least
    assert 40 <= high.sum() < len(score) and all(np.array_equal(a[high], b[high]) for a, b in zip((score, p, q), again, strict=True)) and (again[0][~high] < least[~high]).all()
