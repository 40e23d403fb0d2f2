"""The interval algebra: lists of minimal intervals (doc_id, p, q, v) and operators between them.

Places are local to a document, so every operator is one pass over the rows of a document in order
of an address: a window over doc_id, no range join. Lists keep the invariant that p and q both
strictly increase. ``v`` survives filters and is 0 for intervals that an operator makes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ["doc_id", "p", "q", "v"]


class GclError(ValueError):
    """An expression that can't be evaluated."""


def _by(*order: str) -> Window:
    return Window.partitionBy("doc_id").orderBy(*order)


def least_ends(rows: DataFrame) -> DataFrame:
    """Of rows whose p doesn't fall as q grows, the least q of each p."""
    return rows.groupBy("doc_id", "p").agg(F.min("q").alias("q")).withColumn("v", F.lit(0.0))


def gc_reduce(rows: DataFrame, rank: Column | None = None) -> DataFrame:
    """Drop intervals that contain another; of equal ones the value of the least ``rank`` (then the
    least value) stays."""
    first = F.min(F.struct(*([rank.alias("r")] if rank is not None else []), "v")).alias("best")
    one = rows.groupBy("doc_id", "p", "q").agg(first).select("doc_id", "p", "q", F.col("best.v").alias("v"))
    # of the intervals that start at p the shortest; then those that end before all that start later
    shortest = one.groupBy("doc_id", "p").agg(F.min(F.struct("q", "v")).alias("s")).select("doc_id", "p", "s.q", "s.v")
    later = F.min("q").over(_by("p").rowsBetween(1, Window.unboundedFollowing))
    return shortest.withColumn("later", later).where(F.col("later").isNull() | (F.col("q") < F.col("later"))).select(*COLUMNS)


def _sides(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [rows.select(*COLUMNS, F.lit(i).alias("side")) for i, rows in enumerate(lists)])


def all_of(*lists: DataFrame) -> DataFrame:
    """Minimal intervals that hold one of each list."""
    return all_of_sides(_sides(*lists), len(lists))


def all_of_sides(rows: DataFrame, n: int) -> DataFrame:
    """``all_of`` of n lists in one table, told apart by ``side``: at each end, back to the least of the lists' latest starts."""
    seen = _by("q").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("side") == i, F.col("p"))).over(seen).alias(f"last{i}") for i in range(n)]
    rows = rows.select("doc_id", "q", *last)
    for i in range(n):
        rows = rows.where(F.col(f"last{i}").isNotNull())
    start = F.least(*[F.col(f"last{i}") for i in range(n)]) if n > 1 else F.col("last0")
    return least_ends(rows.select("doc_id", start.alias("p"), "q"))


def one_of(*lists: DataFrame) -> DataFrame:
    """Minimal intervals of all lists."""
    return one_of_sides(_sides(*lists))


def one_of_sides(rows: DataFrame) -> DataFrame:
    return gc_reduce(rows.select(*COLUMNS)).withColumn("v", F.lit(0.0))


def merge(*lists: DataFrame) -> DataFrame:
    """As ``one_of``, with values; of equal intervals the first list's stays."""
    return gc_reduce(_sides(*lists), F.col("side"))


def followed_by(a: DataFrame, b: DataFrame) -> DataFrame:
    """Minimal intervals from one of a to one of b that starts after a's end."""
    return followed_by_sides(_sides(a, b))


def followed_by_sides(rows: DataFrame) -> DataFrame:
    first = F.col("side") == 0
    ends = rows.select("doc_id", F.when(first, F.col("q")).otherwise(F.col("p")).alias("at"), F.when(first, F.col("p")).alias("start"), F.when(~first, F.col("q")).alias("q"))
    before = F.max("start").over(_by("at").rangeBetween(Window.unboundedPreceding, -1))
    return least_ends(ends.withColumn("p", before).where("q is not null and p is not null").select("doc_id", "p", "q"))


def contained_in_sides(rows: DataFrame, yes: bool = True) -> DataFrame:
    """Those of side 0 that lie (not) in one of side 1, by the end of the last of side 1 that starts no later: among
    minimal intervals the furthest end."""
    upto = _by("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("far", F.max(F.when(F.col("side") == 1, F.col("q"))).over(upto)).where("side = 0")
    held = F.coalesce(F.col("far") >= F.col("q"), F.lit(False))
    return found.where(held if yes else ~held).select(*COLUMNS)


def containing_sides(rows: DataFrame, yes: bool = True) -> DataFrame:
    """Those of side 0 that (don't) hold one of side 1, by the end of the first of side 1 that starts no earlier: among
    minimal intervals the nearest end."""
    on = _by("p").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = rows.withColumn("near", F.min(F.when(F.col("side") == 1, F.col("q"))).over(on)).where("side = 0")
    holds = F.coalesce(F.col("near") <= F.col("q"), F.lit(False))
    return found.where(holds if yes else ~holds).select(*COLUMNS)


def contained_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return contained_in_sides(_sides(a, b))


def not_contained_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return contained_in_sides(_sides(a, b), False)


def containing(a: DataFrame, b: DataFrame) -> DataFrame:
    return containing_sides(_sides(a, b))


def not_containing(a: DataFrame, b: DataFrame) -> DataFrame:
    return containing_sides(_sides(a, b), False)


def link(a: DataFrame) -> DataFrame:
    """The values, read as addresses, as intervals of one place."""
    at = F.col("v").cast("long")
    return a.where("v is not null").select("doc_id", at.alias("p"), at.alias("q"), F.lit(0.0).alias("v")).distinct()


def phrase(*terms: DataFrame) -> DataFrame:
    """Adjacent places of one list each."""
    return phrase_sides(_sides(*terms), len(terms))


def phrase_sides(rows: DataFrame, n: int) -> DataFrame:
    """Adjacent places of n lists: every place votes for the start that it would belong to, and a start with all votes is a
    phrase. One aggregation, combined before the shuffle, whatever the number of words."""
    start = rows.select("doc_id", (F.col("p") - F.col("side")).alias("p"), "side")
    votes = start.groupBy("doc_id", "p").agg(F.count_distinct("side").alias("n")) if n > 62 else start.groupBy("doc_id", "p").agg(F.bit_or(F.expr("shiftleft(1L, side)")).alias("n"))
    return votes.where(F.col("n") == (n if n > 62 else (1 << n) - 1)).select("doc_id", "p", (F.col("p") + (n - 1)).alias("q"), F.lit(0.0).alias("v"))


# Windows of n tokens are an infinite list, so they only exist inside another operator.

LENGTH = "q - p + 1"


def windows_containing(n: int, b: DataFrame) -> DataFrame:
    """All windows of n tokens that hold one of b."""
    start = F.explode(F.sequence(F.col("q") - (n - 1), F.col("p")))
    return b.where(f"{LENGTH} <= {n}").select("doc_id", start.alias("p")).distinct().select("doc_id", "p", (F.col("p") + (n - 1)).alias("q"), F.lit(0.0).alias("v"))


def windows_inside(n: int, b: DataFrame) -> DataFrame:
    """All windows of n tokens inside one of b."""
    start = F.explode(F.sequence(F.col("p"), F.col("q") - (n - 1)))
    return b.where(f"{LENGTH} >= {n}").select("doc_id", start.alias("p")).distinct().select("doc_id", "p", (F.col("p") + (n - 1)).alias("q"), F.lit(0.0).alias("v"))


def window_then(n: int, b: DataFrame) -> DataFrame:
    return b.select("doc_id", (F.col("p") - n).alias("p"), "q", F.lit(0.0).alias("v"))


def then_window(a: DataFrame, n: int) -> DataFrame:
    return a.select("doc_id", "p", (F.col("q") + n).alias("q"), F.lit(0.0).alias("v"))


def window_and(n: int, b: DataFrame) -> DataFrame:
    """Minimal intervals that hold one of b and n tokens."""
    return gc_reduce(windows_containing(n, b).unionByName(b.where(f"{LENGTH} >= {n}").select(*COLUMNS))).withColumn("v", F.lit(0.0))


def longer(a: DataFrame, n: int, yes: bool = True) -> DataFrame:
    return a.where(f"{LENGTH} >= {n}" if yes else f"{LENGTH} < {n}")


def shorter(a: DataFrame, n: int, yes: bool = True) -> DataFrame:
    return a.where(f"{LENGTH} <= {n}" if yes else f"{LENGTH} > {n}")


def single(spark: SparkSession, doc_id: int | None = None, p: int = 0, q: int = 0, v: float = 0.0) -> DataFrame:
    """A list of one interval; without a document the empty list."""
    return spark.createDataFrame([] if doc_id is None else [(doc_id, p, q, v)], "doc_id long, p long, q long, v double")


def with_content(points: DataFrame, content: DataFrame) -> DataFrame:
    """Values annotated at one place, (doc_id, p, v), with the content interval that starts there."""
    return points.select("doc_id", "p", "v").join(content.select("doc_id", "p", "q"), ["doc_id", "p"]).select("doc_id", "p", "q", "v")
