"""Parameters of rankers: lookup, grids, random draws, bootstrap over topics; and the random ranking."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspan.operators import ranking as rk

#: Defaults of the rankers' parameters.
DEFAULTS = {"bm25:k1": 0.5, "bm25:b": 0.25, "bm25:depth": 1000, "lmd:mu": 2000.0, "ssr:K": 42.0, "kld:expansions": 8, "kld:depth": 16, "kld:gamma": 1 / 3, "rsj:expansions": 25, "rsj:depth": 10, "rsj:gamma": 0.2, "qa:window": 64}


def parameter(ranker: str, name: str, given: dict[str, float]) -> float:
    """``ranker:name``, else ``name``, else the default."""
    return given.get(f"{ranker}:{name}", given.get(name, DEFAULTS[f"{ranker}:{name}"]))


def grid(**values: list[float]) -> Iterator[dict[str, float]]:
    """All combinations of the values of each parameter."""
    for combination in itertools.product(*values.values()):
        yield dict(zip(values, combination, strict=True))


def draws(n: int, seed: int, **ranges: tuple[float, float, bool]) -> Iterator[dict[str, float]]:
    """Random settings: (low, high, whether the logarithm is uniform) of each parameter."""
    rng = random.Random(seed)
    for _ in range(n):
        yield {k: math.exp(rng.uniform(math.log(a), math.log(b))) if logs else rng.uniform(a, b) for k, (a, b, logs) in ranges.items()}


def trials(rank: Callable[[dict[str, float]], DataFrame], settings: list[dict[str, float]], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(trial, topic, value): the metric of each topic under each setting."""
    rows = None
    for n, setting in enumerate(settings):
        found = score(rank(setting)).withColumn("trial", F.lit(n))
        rows = found if rows is None else rows.unionByName(found)
    return rows


def bm25_trials(stats: rk.Statistics, query: DataFrame, settings: list[dict[str, float]], depth: int) -> DataFrame:
    """(trial, k1, b, topic, doc_id, score, rank): BM25 under each setting, in one job: postings are read and joined with the query
    once, and each document is scored under every setting at its place."""
    if rk._few(query):
        found = rk.best_bm25_of(stats, query, depth, [(s["k1"], s["b"]) for s in settings])
        of = lambda name: F.element_at(F.array(*[F.lit(float(s[name])) for s in settings]), F.col("trial") + 1).alias(name)
        return found.select("trial", of("k1"), of("b"), "topic", "doc_id", "score", "rank")
    tf, terms = stats
    weighted = rk.weighted_terms(query, terms)
    trial = F.explode(F.array(*[F.struct(F.lit(n).alias("trial"), F.lit(s["k1"]).alias("k1"), F.lit(s["b"]).alias("b")) for n, s in enumerate(settings)])).alias("s")
    rows = tf.join(F.broadcast(weighted) if rk._few(query) else weighted, "term").select("topic", "doc_id", "weight", "rsj", "tf", "len", "avgl", trial).select("*", "s.*")
    gain = F.col("weight") * F.col("rsj") * F.col("tf") / (F.col("k1") * ((1 - F.col("b")) + F.col("b") * F.col("len") / F.col("avgl")) + F.col("tf"))
    scores = rows.groupBy("trial", "k1", "b", "topic", "doc_id").agg(F.sum(gain).alias("score")).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("trial", "topic").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def bootstrap(values: DataFrame, samples: int = 1000, seed: int = 1) -> DataFrame:
    """(trial, mean, wins): the mean of each trial, and in how many resamples of the topics it was best.

    ``values`` has (trial, topic, value); each resample draws as many topics as there are, with replacement, by Poisson weights.
    """
    topics = values.select("topic").distinct().select("topic", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    chance = F.pmod(F.xxhash64(F.lit(seed), "topic", "sample"), F.lit(1 << 30)) / float(1 << 30)
    # the number of times a topic is drawn, by inversion of the Poisson law
    cuts = list(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(8)))
    times = sum(((chance >= c).cast("int") for c in cuts), F.lit(0))
    drawn = values.join(topics.withColumn("times", times), "topic").groupBy("trial", "sample").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("mean"))
    best = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("mean"), "trial"))
    wins = drawn.withColumn("n", best).groupBy("trial").agg(F.sum((F.col("n") == 1).cast("long")).alias("wins"))
    return values.groupBy("trial").agg(F.avg("value").alias("mean")).join(wins, "trial")


def random_ranking(docs: DataFrame, depth: int, seed: int) -> DataFrame:
    """(doc_id, score): ``depth`` documents in an order that is random, and the same for one seed."""
    score = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return docs.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(depth)
