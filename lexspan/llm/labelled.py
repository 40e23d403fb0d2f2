"""Bounded, labelled training rows for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm._shared import materialize, remainder


def training_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, out: int, most: int, text_col: str = "text") -> DataFrame:
    """(doc_id, y, part, text) of at most ``most`` labelled documents that aren't held out.

    Held out are ids with crc32(id as text) mod ``mod`` = ``out``. Beyond ``most`` labels those with
    the least hash of the id are taken, whatever the order of rows. Rows without id or label teach
    nothing; of several labels of one id the largest holds, of several texts of one id the one with the
    least hash, so no more than ``most`` rows reach the driver. ``part`` is a second hash, 0 to 9, that
    sets rows aside for calibration. The ids are bounded by ``most``, so they are broadcast and only
    their texts are shuffled; the rows are written once and read again by every pass of the training.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder(F.col("doc_id"), mod) != out))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(10)).cast("int").alias("part")
    own = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return materialize(own.select("doc_id", "y", part, "text"), f"train-{label}")
