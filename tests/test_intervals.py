"""Lowerings against the definitions of the operators, on random lists."""

import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import intervals as iv
from lexspan.operators.intervals import GclError
from lexspan.plans.engine import Engine


def minimal(rows):
    rows = set(rows)
    return {x for x in rows if not any(y != x and y[0] == x[0] and x[1] <= y[1] and y[2] <= x[2] for y in rows)}


def random_list(rng, docs=25, most=8, span=30):
    return minimal({(d, p, p + rng.choice([0, 0, 1, 2, 5])) for d in range(docs) for p in rng.sample(range(span), rng.randint(0, most))})


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in sorted(rows)], "doc_id long, p long, q long, v double")


def result(df):
    rows = [(r.doc_id, r.p, r.q) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(4)
    made = [random_list(rng) for _ in range(3)]
    return made, [frame(spark, x) for x in made]


def both(a, b):
    return {(x[0], min(x[1], y[1]), max(x[2], y[2])) for x in a for y in b if x[0] == y[0]}


def inside(x, ys):
    return any(x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in ys)


def holds(x, ys):
    return any(x[0] == y[0] and x[1] <= y[1] and y[2] <= x[2] for y in ys)


def test_operators(lists):
    (a, b, c), (fa, fb, fc) = lists
    assert result(iv.all_of(fa, fb)) == minimal(both(a, b))
    assert result(iv.all_of(fa, fb, fc)) == minimal(both(both(a, b), c))
    assert result(iv.one_of(fa, fb, fc)) == minimal(a | b | c)
    assert result(iv.followed_by(fa, fb)) == minimal({(x[0], x[1], y[2]) for x in a for y in b if x[0] == y[0] and x[2] < y[1]})
    assert result(iv.contained_in(fa, fb)) == {x for x in a if inside(x, b)}
    assert result(iv.not_contained_in(fa, fb)) == {x for x in a if not inside(x, b)}
    assert result(iv.containing(fa, fb)) == {x for x in a if holds(x, b)}
    assert result(iv.not_containing(fa, fb)) == {x for x in a if not holds(x, b)}


@pytest.mark.parametrize("n", [1, 3, 6])
def test_windows(lists, n):
    (a, _, _), (fa, _, _) = lists
    wins = {(d, s, s + n - 1) for d in range(25) for s in range(-10, 50)}
    assert result(iv.windows_containing(n, fa)) == {w for w in wins if holds(w, a)}
    assert result(iv.windows_inside(n, fa)) == {w for w in wins if inside(w, a)}
    assert result(iv.window_and(n, fa)) == minimal(both(wins, a))
    assert result(iv.then_window(fa, n)) == {(d, p, q + n) for d, p, q in a}
    assert result(iv.longer(fa, n)) == {x for x in a if x[2] - x[1] + 1 >= n}


def test_merge_keeps_first_value(spark):
    one = spark.createDataFrame([(1, 0, 2, 7.0), (1, 5, 9, 8.0)], "doc_id long, p long, q long, v double")
    two = spark.createDataFrame([(1, 0, 2, 9.0), (1, 6, 7, 3.0)], "doc_id long, p long, q long, v double")
    assert sorted(tuple(r) for r in iv.merge(one, two).collect()) == [(1, 0, 2, 7.0), (1, 6, 7, 3.0)]


def test_link_and_phrases(spark):
    docs = spark.createDataFrame([(1, "Hello world hello Hello world"), (2, ""), (3, None)], "doc_id long, text string")
    engine = Engine(docs)
    assert result(engine.gcl('"hello world"')) == {(1, 0, 1), (1, 3, 4)}
    assert result(engine.gcl("(>> :item (^ hello world))")) == {(1, 0, 4)}
    assert result(engine.gcl("(+ nowhere)")) == set()
    edge = spark.createDataFrame([(1, 4, 4, 2.0), (1, 5, 5, 2.0), (1, 6, 6, None)], "doc_id long, p long, q long, v double")
    assert result(iv.link(edge)) == {(1, 2, 2)}
    for bad in ("(# 3)", "(+ (# 3) hello)", "(!> (# 3) hello)"):
        with pytest.raises(GclError):
            engine.gcl(bad)


def test_translate(spark):
    engine = Engine(spark.createDataFrame([(1, "One two, three four.")], "doc_id long, text string"))
    spans = spark.createDataFrame([(1, -2, 1), (1, 2, 9), (1, 3, 2)], "doc_id long, p long, q long")
    assert [r.said for r in engine.translate(spans).orderBy("p").collect()] == ["one two", "three four", ""]


def test_partitions_do_not_matter(lists):
    _, (fa, fb, _) = lists
    assert result(iv.all_of(fa.repartition(1), fb)) == result(iv.all_of(fa.repartition(5, F.rand(1)), fb.repartition(3)))
