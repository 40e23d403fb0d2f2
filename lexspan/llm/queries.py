"""The registered queries of the training-data operators: thin, with production parameters, over
whole tables. Spelling variants and conversation repair have SQL; tests hold all of them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import (
    bpe, conversation_repair, decontamination, embedding_dedup, near_dedup, oracles, phrase_dedup, quality, secrets, sentencepiece_bpe,
    sharding, spelling, suffix_dedup, toxicity,
)
from lexspan.llm._shared import remainder, table


def vocab_path() -> str:
    """The vocabulary file that queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    """The SentencePiece model that queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def verdicts(scored: DataFrame, score_col: str, mod: int, out: int) -> DataFrame:
    """doc_id, held_out, score, predicted; a null id is not held out."""
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), mod) == out, F.lit(False)).alias("held_out"),
        F.col(score_col).alias("score"),
        (F.col(score_col) >= 0.5).cast("int").alias("predicted"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.slim(table(spark, sf_dir, "documents"))
    return sharding.shard_rows(rows, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return verdicts(scored.withColumn("n_passages", F.size("toxic_passages")), "toxicity", 5, 0)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 5, 85)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab_path()))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digests(phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"), 20))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return verdicts(quality.score_documents(docs, model), "quality_score", 3, 1)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.misspelt(spelling.runs(table(spark, sf_dir, "documents")))
    return spelling.group_variants(spelling.word_counts(words, 5, 3), 2.0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(table(spark, sf_dir, "conversations"), damage=True)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(docs, piece_model_path(), packed=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sharding, op2_suffix_dedup, op3_toxicity, op4_near_dedup, op5_bpe, op6_secrets, op7_phrase_dedup, op8_decontamination, op9_embedding_dedup, op10_quality, op11_spelling, op12_conversation_repair, op13_sentencepiece]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_spelling": oracles.SPELLING, "op12_conversation_repair": oracles.CONVERSATIONS}
