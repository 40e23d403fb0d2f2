"""Retrieval metrics by topic. Runs are (topic, doc_id, rank), rank from 1; judgments (topic, doc_id, grade)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The constants of time-biased gain.
CLICK_GOOD, CLICK_BAD, SAVE = 0.64, 0.39, 0.77
SUMMARY_S, WORD_S, TEXT_S, HALF_LIFE_S = 4.4, 0.018, 7.8, 224.0


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with the grade of each document, 0 where there is none."""
    grades = qrels.groupBy("topic", "doc_id").agg(F.max("grade").alias("grade"))
    return run.join(grades, ["topic", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))


def needed(qrels: DataFrame) -> DataFrame:
    """(topic, rel): how many documents are relevant."""
    return qrels.groupBy("topic").agg(F.sum((F.col("grade") > 0).cast("long")).alias("rel"))


def precision_metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """ap, rr, p05, p10, p20, ret, rel, rel_ret, precision, recall. rr is the reciprocal of the first relevant rank."""
    good = (F.col("grade") > 0).cast("long")
    hits = F.sum(good).over(Window.partitionBy("topic").orderBy("rank"))
    rows = judged(run, qrels).withColumn("good", good).withColumn("hits", hits)
    at = lambda k: (F.sum(F.when(F.col("rank") <= k, F.col("good")).otherwise(0)) / k).alias(f"p{k:02d}")
    found = rows.groupBy("topic").agg(
        F.sum(F.col("good") * F.col("hits") / F.col("rank")).alias("gain"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"),
        at(5), at(10), at(20), F.count("*").alias("ret"), F.sum("good").alias("rel_ret"),
    )
    rel = F.col("rel")
    share = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    return found.join(needed(qrels), "topic").select(
        "topic", share(F.col("gain"), rel).alias("ap"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), "p05", "p10", "p20",
        "ret", "rel", "rel_ret", share(F.col("rel_ret"), F.col("ret")).alias("precision"), share(F.col("rel_ret"), rel).alias("recall"),
    )


def discounted(rank: Column) -> Column:
    return math.log(2) / F.log(rank + 1)


def ndcg_metrics(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """dcg and ndcg of whole runs and at the cuts."""
    ideal = qrels.where("grade > 0").withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("grade"), "doc_id")))

    def sums(rows: DataFrame, name: str) -> DataFrame:
        part = F.col("grade") * discounted(F.col("rank"))
        return rows.groupBy("topic").agg(F.sum(part).alias(name), *[F.sum(F.when(F.col("rank") <= k, part).otherwise(0.0)).alias(f"{name}{k:02d}") for k in cuts])

    both = sums(judged(run, qrels), "dcg").join(sums(ideal, "best"), "topic", "left")
    names = ["", *[f"{k:02d}" for k in cuts]]
    return both.select("topic", *[F.col(f"dcg{n}") for n in names], *[F.when(F.col(f"best{n}") > 0, F.col(f"dcg{n}") / F.col(f"best{n}")).otherwise(0.0).alias(f"ndcg{n}") for n in names])


def rbp_metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    part = lambda p: ((1 - p) * F.sum(F.when(F.col("grade") > 0, F.pow(F.lit(p), F.col("rank") - 1)).otherwise(0.0)))
    return judged(run, qrels).groupBy("topic").agg(part(0.5).alias("rbp50"), part(0.95).alias("rbp95"))


def time_biased_gain(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``run`` also has ``len``, the words of each document."""
    good = F.col("grade") > 0
    cost = SUMMARY_S + (WORD_S * F.col("len") + TEXT_S) * F.when(good, CLICK_GOOD).otherwise(CLICK_BAD)
    spent = F.coalesce(F.sum("cost").over(Window.partitionBy("topic").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = judged(run, qrels).withColumn("cost", cost).withColumn("spent", spent)
    gain = F.when(good, CLICK_GOOD * SAVE * F.exp(-F.col("spent") * math.log(2) / HALF_LIFE_S)).otherwise(0.0)
    return rows.groupBy("topic").agg(F.sum(gain).alias("tbg"))


def effectiveness_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """How far two runs of a topic can differ at most, under the best judgments for either."""
    a, b = one.select("topic", "doc_id", F.col("rank").alias("r1")), two.select("topic", "doc_id", F.col("rank").alias("r2"))
    rows = a.join(b, ["topic", "doc_id"], "full")

    def half(own: str, other: str, wins: Column, name: str) -> list[Column]:
        # a document counts as relevant for one run if that run has it, and no later than the other
        good = F.col(own).isNotNull() & (F.col(other).isNull() | wins)
        gain = lambda f: F.sum(F.when(good, f(F.col(own)) - F.coalesce(f(F.col(other)), F.lit(0.0))).otherwise(0.0))
        return [gain(discounted).alias(f"dcg{name}"), *[((1 - p) * gain(lambda r, p=p: F.pow(F.lit(p), r - 1))).alias(f"rbp{int(p * 100)}{name}") for p in (0.5, 0.95)]]

    found = rows.groupBy("topic").agg(*half("r1", "r2", F.col("r1") <= F.col("r2"), "a"), *half("r2", "r1", F.col("r2") <= F.col("r1"), "b"), F.greatest(F.max("r1"), F.max("r2")).alias("depth"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("depth").cast("int")), F.lit(0.0), lambda s, r: s + discounted(r))
    best = {n: F.greatest(f"{n}a", f"{n}b") for n in ("dcg", "rbp50", "rbp95")}
    return found.select("topic", *[c.alias(f"med_{n}") for n, c in best.items()], (best["dcg"] / ideal).alias("med_ndcg"))


def means(metrics: DataFrame) -> DataFrame:
    """(metric, mean, topics) over all topics of a table of metrics."""
    names = [c for c in metrics.columns if c != "topic"]
    long = metrics.select("topic", F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("metric", "value"))
    return long.where("value is not null").groupBy("metric").agg(F.avg("value").alias("mean"), F.count("*").alias("topics"))


def rescaled_grades(qrels: DataFrame, exponential: bool = True) -> DataFrame:
    """Negative grades are 0; then (2^g - 1) / 2^max of all, or g / max."""
    g = F.greatest(F.col("grade").cast("double"), F.lit(0.0))
    most = qrels.agg(F.max(g).alias("most"))
    value = (F.pow(F.lit(2.0), g) - 1) / F.pow(F.lit(2.0), F.col("most")) if exponential else F.when(F.col("most") > 0, g / F.col("most")).otherwise(0.0)
    return qrels.crossJoin(F.broadcast(most)).select("topic", "doc_id", value.alias("grade"))
