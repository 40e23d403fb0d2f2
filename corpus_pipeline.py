"""A corpus pipeline of five stages over ``documents``: toxic documents go, one document of each
near-duplicate group stays, documents with benchmark passages go, secrets are cut out of the texts,
and what is left is encoded.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all documents that
the one before it kept, and returns a DataFrame, which is written as Parquet and read again for the
next one. All but the last return the columns of ``documents``. Rows without an id are kept by every
stage that decides by id, as nothing can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspan.llm import bpe, decontamination, near_dedup, secrets, toxicity
from lexspan.llm._shared import materialize, table
from lexspan.llm.queries import vocab_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below one half, learned from the labels outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, passages = "lexspan_toxicity", "lexspan_passages"
    return toxicity.score_documents(docs, model, score_col=score, passages_col=passages).where(F.col(score) < 0.5).drop(score, passages)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group, linked at a similarity of 0.8 or more over five words.

    Of equal rows (id and text) the first in the order of the other columns stays; different texts of one
    id all stay. The ids that go are distinct, so joining and numbering share one exchange.
    """
    gone = near_dedup.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rest = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    same = Window.partitionBy("doc_id", F.xxhash64("text"), F.hash("text")).orderBy(F.struct(*rest))
    first = F.col("doc_id").isNull() | (F.row_number().over(same) == 1)
    return left.withColumn("lexspan_first", first).where("lexspan_first").drop("lexspan_first")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    hits = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*docs.columns)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark; n_chars follows the text."""
    cut = secrets.redact(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and what encoding and decoding give of each text."""
    ids, decoded = "lexspan_ids", "lexspan_decoded"
    coded = bpe.encode_decode(docs, vocab_path(), ids_col=ids, decoded_col=decoded)
    return coded.select(
        "doc_id", "lang", "source",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", cut_secrets),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
