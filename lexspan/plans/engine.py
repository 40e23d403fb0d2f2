"""The engine: documents, their tokens and annotations, and everything that reads them.

``Engine`` reads the texts themselves. ``StoredEngine`` reads a stored index of postings instead, wherever a term, a
frequency or a total is asked for, and the texts only where words must be shown.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.operators import ranking as rk
from lexspan.plans.gcl import Expr, Lowering
from lexspan.sources.postings import Postings, placed
from lexspan.sources.workspace import passing_folder

#: Terms of a query that are named in the plan, so that only their folders are read.
SMALL = 64
ANNOTATIONS = "feature string, doc_id long, p long, q long, v double"


class Engine:
    """Documents (doc_id, text) with annotations (feature, doc_id, p, q, v) on their token places."""

    def __init__(self, docs: DataFrame, annotations: DataFrame | None = None, stem: bool = False) -> None:
        self.spark: SparkSession = docs.sparkSession
        self.docs, self.stem = docs, stem
        self.annotations = annotations if annotations is not None else self.spark.createDataFrame([], ANNOTATIONS)

    @cached_property
    def plain(self) -> DataFrame:
        """(doc_id, term, pos): the words as they stand."""
        return tx.tokens(self.docs)

    @cached_property
    def tokens(self) -> DataFrame:
        """``plain``, with the stems of words beside them if the engine stems."""
        return tx.with_stems(self.plain) if self.stem else self.plain

    def lengths(self) -> DataFrame:
        """(doc_id, len): the number of words of each document with a word; no token is shuffled."""
        n = F.size(tx.words(F.col("text"))).cast("long")
        return self.docs.select("doc_id", n.alias("len")).where("len > 0").groupBy("doc_id").agg(F.sum("len").alias("len"))

    def items(self) -> DataFrame:
        """(doc_id, p, q, v): each document with a token, as one interval."""
        n = F.size(tx.words(F.col("text"))).cast("long")
        return self.docs.select("doc_id", F.lit(0).cast("long").alias("p"), (n - 1).alias("q"), F.lit(0.0).alias("v")).where("q >= 0")

    def places(self, terms: list[str]) -> DataFrame:
        """(term, doc_id, pos) of some terms, in one scan."""
        return self.tokens.where(F.col("term").isin(*terms)).select("term", "doc_id", "pos")

    def lists(self) -> DataFrame:
        """(term, doc_id, places) of all words."""
        return self.plain.groupBy("term", "doc_id").agg(F.collect_list("pos").alias("places"))

    def leaf(self, feature: str) -> DataFrame:
        """The list of one feature: a term, ``:item``, or an annotation."""
        if feature == ":item":
            return self.items()
        if feature.startswith(":"):
            return self.annotations.where(F.col("feature") == feature).select("doc_id", "p", "q", "v")
        return self.places([feature]).select("doc_id", F.col("pos").alias("p"), F.col("pos").alias("q"), F.lit(0.0).alias("v"))

    def gcl(self, expr: Expr | str) -> DataFrame:
        """(doc_id, p, q, v) of an expression."""
        return Lowering(self.leaf, self.places, self.shared)(expr)

    def shared(self, rows: DataFrame) -> DataFrame:
        """A list that is read more than once, written."""
        path = passing_folder(self.spark, "list")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def totals(self) -> dict[str, int]:
        """items, length and vocab of the collection."""
        return rk.totals(self.plain).first().asDict()

    def counts(self, terms: list[str]) -> dict[str, int]:
        """How often each of some terms stands in the collection."""
        return dict(self.plain.where(F.col("term").isin(*terms)).groupBy("term").count().collect())

    def frequencies(self) -> DataFrame:
        """(doc_id, term, tf) of all words."""
        return rk.term_frequencies(self.plain)

    def vocabulary(self, stems: bool = False, asked: DataFrame | None = None) -> DataFrame:
        """(term, df, cf) of all words, with items, length, vocab and avgl of the collection; with ``stems`` those too, at
        least of the terms ``asked`` for."""
        df = rk.document_frequencies(rk.term_frequencies(self.tokens if stems else self.plain))
        return df.crossJoin(F.broadcast(rk.totals(self.plain)))

    def statistics(self, query: DataFrame, stems: bool = False) -> rk.Statistics:
        """What rankers read of a query's terms."""
        return rk.statistics(self.tokens if stems else self.plain, query, self.lengths())

    def tokens_of(self, ids: DataFrame, stems: bool = False) -> DataFrame:
        """(doc_id, term, pos) of the documents of a ranking: only their texts are cut into words."""
        plain = tx.tokens(self.docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))
        return tx.with_stems(plain) if stems else plain

    def translate(self, spans: DataFrame) -> DataFrame:
        """``spans`` with the words of each; places below 0 count from 0, reversed spans are empty."""
        words = self.docs.select("doc_id", tx.words(F.col("text")).alias("lexspan_words"))
        start = F.greatest(F.col("p"), F.lit(0))
        size = F.greatest(F.col("q") - start + 1, F.lit(0))
        said = F.array_join(F.slice("lexspan_words", (start + 1).cast("int"), size.cast("int")), " ")
        return spans.join(words, "doc_id").withColumn("said", said).drop("lexspan_words")

    def around(self, spans: DataFrame, n: int) -> DataFrame:
        """(doc_id, p, q, before, said, after): spans with their words and the ``n`` before and after."""
        words = self.docs.select("doc_id", tx.words(F.col("text")).alias("words"))
        part = lambda start, size: F.array_join(F.slice("words", (start + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int")), " ")
        start = F.greatest(F.col("p") - n, F.lit(0))
        rows = spans.join(words, "doc_id")
        return rows.select("doc_id", "p", "q", part(start, F.col("p") - start).alias("before"), part(F.col("p"), F.col("q") - F.col("p") + 1).alias("said"), part(F.col("q") + 1, F.lit(n)).alias("after"))


class StoredEngine(Engine):
    """An engine over a stored index of the documents."""

    def __init__(self, index: Postings, docs: DataFrame, annotations: DataFrame | None = None, stem: bool = False) -> None:
        super().__init__(docs, annotations, stem)
        self.index = index

    @cached_property
    def plain(self) -> DataFrame:
        return self.index.tokens.select("doc_id", "term", "pos")

    @cached_property
    def tokens(self) -> DataFrame:
        if not self.stem:
            return self.plain
        family = self.index.stems.select("slot", F.col("term").alias("word"), F.concat(F.lit("porter:"), "stem").alias("term"))
        stems = placed(self.index.lists.withColumnRenamed("term", "word").join(family, ["slot", "word"]))
        return self.plain.unionByName(stems.select("doc_id", "term", "pos"))

    def lengths(self) -> DataFrame:
        return self.index.lengths.select("doc_id", "len")

    def items(self) -> DataFrame:
        return self.index.lengths.select("doc_id", F.lit(0).cast("long").alias("p"), F.col("last").alias("q"), F.lit(0.0).alias("v"))

    def places(self, terms: list[str]) -> DataFrame:
        return self.index.places(terms)

    def lists(self) -> DataFrame:
        return self.index.lists.select("term", "doc_id", "places")

    def totals(self) -> dict[str, int]:
        return {"items": self.index.items, "length": self.index.length, "vocab": self.index.vocab}

    def counts(self, terms: list[str]) -> dict[str, int]:
        return dict(self.index.in_slots(self.index.terms, terms).select("term", "cf").collect())

    def frequencies(self) -> DataFrame:
        return self.index.postings.select("doc_id", "term", "tf")

    def vocabulary(self, stems: bool = False, asked: DataFrame | None = None) -> DataFrame:
        df = self.index.terms.select("term", "df", "cf")
        return self.index.with_totals(df.unionByName(self.index.stem_counts(asked)) if stems else df)

    def tokens_of(self, ids: DataFrame, stems: bool = False) -> DataFrame:
        plain = super().tokens_of(ids)
        if not stems:
            return plain
        stem = self.index.stems.select("term", F.concat(F.lit("porter:"), "stem").alias("stem"))
        return plain.unionByName(plain.join(stem, "term").select("doc_id", F.col("stem").alias("term"), "pos"))

    def statistics(self, query: DataFrame, stems: bool = False) -> rk.Statistics:
        if rk.size_of(query) <= SMALL:
            return self.index.statistics([r.term for r in query.select("term").distinct().collect()], stems)
        return self.index.statistics(query.select("term").distinct() if stems else None, stems)
