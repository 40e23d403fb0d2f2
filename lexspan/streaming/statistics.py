"""Collection statistics that follow a stream of documents: Structured Streaming keeps the counts as state, and each
micro-batch writes the terms that it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions import text as tx

#: The term under which documents and words are counted.
TOTAL = ""


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, cf) of documents, batch or stream; under ``TOTAL`` the documents with a word, and all words.

    Documents and words are counted where the texts are cut, so one grouping adds up rows of many documents, not of one word each.
    A document is one row.
    """
    return tx.tallies(docs, text_col).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def keep_statistics(stream: DataFrame, path: str, checkpoint: str, text_col: str = "text", **trigger):
    """A streaming query that writes, for each micro-batch, the new counts of the terms in it. A batch that is tried again
    overwrites its own folder. ``trigger`` is as of ``writeStream.trigger``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = term_counts(stream, text_col).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def statistics_now(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, cf) with items, length and avgl, of all batches so far: the latest counts of each term, which
    are its largest, as a stream only adds documents."""
    written = spark.read.schema("term string, df long, cf long, batch long").parquet(path)
    latest = written.groupBy("term").agg(F.max("df").alias("df"), F.max("cf").alias("cf"))
    total = latest.where(F.col("term") == TOTAL).select(F.col("df").alias("items"), F.col("cf").alias("length"), (F.col("cf") / F.col("df")).alias("avgl"))
    return latest.where(F.col("term") != TOTAL).crossJoin(F.broadcast(total))
