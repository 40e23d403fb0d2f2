"""A stored index of postings, so that searches and rankings read lists instead of texts.

Tables below one folder, written once for a state of the documents:

    postings  slot, term, doc_id, tf, len, places   a row for each term of a document, with the document's length and the places
    terms     slot, term, df, cf            the vocabulary
    stems     slot, term, stem              words that differ from their stem; written when first asked for
    lengths   doc_id, len, last             words of each document with a word, and its last place

and ``totals.json`` with items, length and vocabulary size. Places of a term are read from its postings. ``slot`` is a hash of the term and the
partition column: a term's list is read from one folder, and there from the row groups whose statistics hold
the term. Slots are balanced by size when they are written, so a frequent term's slot is many files, written and
read by many tasks. Rankers need no other table: df and length stand beside tf, so scoring joins postings
with the query's terms and adds up by document.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.sources.workspace import file_system, remove, shared_folder

#: Input bytes for each slot, and the least and most of them.
SLOT_BYTES, LEAST_SLOTS, MOST_SLOTS = 32 << 20, 8, 4096
VERSION = 2
#: Words of the asked families that are named in the plan, so that only their folders are read.
FAMILY = 200


def slot_of(term: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(slots)).cast("int")


def balanced(rows: DataFrame) -> DataFrame:
    """Rows of a slot together, slots of many rows in several tasks, small ones sharing a task."""
    name = f"lexspan_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    try:
        return rows.sparkSession.sql(f"SELECT /*+ REBALANCE(slot) */ * FROM {name}")
    finally:
        rows.sparkSession.catalog.dropTempView(name)


def written(rows: DataFrame, path: str, *order: str) -> None:
    balanced(rows).sortWithinPartitions("slot", *order).write.partitionBy("slot").parquet(path)


def placed(lists: DataFrame) -> DataFrame:
    """A row for each place of lists of places."""
    return lists.withColumn("pos", F.explode("places")).withColumn("pos", F.col("pos").cast("long")).drop("places")


class Postings:
    """A stored index. ``build`` writes one, ``stored`` finds or builds that of a table's present files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        fs, p = file_system(spark, f"{path}/totals.json")
        stream = fs.open(p)
        try:
            told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        self.slots, self.items, self.length, self.vocab = told["slots"], told["items"], told["length"], told["vocab"]
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        self.lists = read("postings", "term string, doc_id long, tf long, len long, places array<int>, slot int")
        self.postings, self.tokens = self.lists.drop("places"), placed(self.lists).select("term", "doc_id", "pos", "slot")
        self.terms = read("terms", "term string, df long, cf long, slot int")
        self.lengths = read("lengths", "doc_id long, len long, last long")

    @classmethod
    def build(cls, docs: DataFrame, path: str, slots: int) -> Postings:
        """Write the index of ``docs`` (doc_id, text) to a folder that must not exist. Texts are cut into words once, and a row for each
        term of a document is shuffled once; the other tables come from these rows."""
        spark = docs.sparkSession
        rows = tx.word_lists(docs)
        if not tx.one_row_each(docs):
            # texts of one id, a null id too, are one document: their places stand side by side
            own = rows.where("array_contains(places, 0)").groupBy("doc_id").agg(F.sum("len").alias("len"), (F.max("len") - 1).alias("last"))
            own.write.parquet(f"{path}/lengths")
            whole = spark.read.schema("doc_id long, len long, last long").parquet(f"{path}/lengths").select(F.col("doc_id").alias("of"), "len")
            sums = rows.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
            rows = sums.join(whole, F.col("doc_id").eqNullSafe(F.col("of"))).drop("of")
        written(rows.select(slot_of(F.col("term"), slots).alias("slot"), "term", "doc_id", "tf", "len", "places"), f"{path}/postings", "term", "doc_id")
        stored = spark.read.schema("term string, doc_id long, tf long, len long, places array<int>, slot int").parquet(f"{path}/postings")
        if not exists(spark, f"{path}/lengths"):
            stored.where("places[0] = 0").select("doc_id", "len", (F.col("len") - 1).alias("last")).write.parquet(f"{path}/lengths")
        lengths, postings = spark.read.schema("doc_id long, len long, last long").parquet(f"{path}/lengths"), stored.drop("places")
        counts = postings.groupBy("slot", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        written(counts.select("slot", "term", "df", "cf"), f"{path}/terms", "term")
        items, length = lengths.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        vocab = spark.read.schema("term string, slot int").parquet(f"{path}/terms").count()
        fs, p = file_system(spark, f"{path}/totals.json")
        out = fs.create(p)
        out.write(bytearray(json.dumps({"version": VERSION, "slots": slots, "items": items, "length": length, "vocab": vocab}).encode()))
        out.close()
        return cls(spark, path)

    @classmethod
    def stored(cls, spark: SparkSession, table: str, docs: DataFrame | None = None, kind: str = "") -> Postings:
        """The index of a Parquet table (doc_id, text), or of ``docs`` made of it and called ``kind``, in the shared folder. Its name follows from the table's files, with their
        sizes and times, so a changed table gets a new index; an index is built aside and named when it is whole."""
        found, total = files_of(spark, table)
        name = hashlib.sha256(json.dumps([VERSION, kind, found]).encode()).hexdigest()[:24]
        path = f"{shared_folder(spark)}/postings-{name}"
        if not exists(spark, f"{path}/totals.json"):
            slots = max(LEAST_SLOTS, min(MOST_SLOTS, total // SLOT_BYTES))
            aside = f"{path}-{uuid.uuid4().hex}"
            cls.build(spark.read.parquet(table).select("doc_id", "text") if docs is None else docs, aside, slots)
            renamed(spark, aside, path)
        return cls(spark, path)

    @cached_property
    def stems(self) -> DataFrame:
        """(slot, term, stem) of the words that differ from their stem: the Python stemmer sees each word of the vocabulary once."""
        path = f"{self.path}/stems"
        if not exists(self.spark, path):
            aside = f"{path}-{uuid.uuid4().hex}"
            stem = F.pandas_udf(tx._stem_all, "string")(F.col("term"))
            written(self.terms.select("slot", "term", stem.alias("stem")).where("term <> stem"), aside, "stem")
            renamed(self.spark, aside, path)
        return self.spark.read.schema("term string, stem string, slot int").parquet(path)

    def in_slots(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        """The rows of some terms: folders and row groups of other terms are not read."""
        if not terms:
            return rows.where("false")
        at = reduce(lambda a, b: a | b, [(F.col("slot") == slot_of(F.lit(t), self.slots)) & (F.col("term") == t) for t in terms])
        return rows.where(at)

    def places(self, terms: list[str]) -> DataFrame:
        """(term, doc_id, pos) of some terms; ``porter:word`` is all terms that differ from their stem, word."""
        found = placed(self.in_slots(self.lists, [t for t in terms if not t.startswith("porter:")])).select("term", "doc_id", "pos")
        asked = [t.removeprefix("porter:") for t in terms if t.startswith("porter:")]
        if asked:
            family = self.stems.where(F.col("stem").isin(*asked)).select("slot", "term", "stem")
            # the words of a few stems are few: their lists are read, and no other list is
            words = [r.term for r in family.select("term").limit(FAMILY + 1).collect()]
            own = self.in_slots(self.lists, words) if len(words) <= FAMILY else self.lists
            found = found.unionByName(placed(own.join(F.broadcast(family), ["slot", "term"])).select(F.concat(F.lit("porter:"), "stem").alias("term"), "doc_id", "pos"))
        return found

    def stemmed(self, asked: DataFrame | None = None) -> DataFrame:
        """(term, doc_id, tf, len) of stems, as ``porter:`` terms: the sums over the words that differ from their stem."""
        family = self.stems.select("slot", F.col("term").alias("word"), F.concat(F.lit("porter:"), "stem").alias("term"))
        if asked is not None:
            family = family.join(asked, "term", "left_semi")
        own = self.postings.withColumnRenamed("term", "word").join(family, ["slot", "word"])
        return own.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))

    def stem_counts(self, asked: DataFrame | None = None) -> DataFrame:
        """(term, df, cf) of stems."""
        return self.stemmed(asked).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def with_totals(self, rows: DataFrame) -> DataFrame:
        """``rows`` with items, length, vocab and avgl as constants."""
        told = {"items": self.items, "length": self.length, "vocab": self.vocab, "avgl": self.length / self.items if self.items else 0.0}
        return rows.withColumns({k: F.lit(v) for k, v in told.items()})

    def statistics(self, terms: list[str] | DataFrame | None = None, stems: bool = False) -> tuple[DataFrame, DataFrame]:
        """(term, doc_id, tf, len) and (term, df, cf) with totals: of a list of terms from their folders alone, else of all terms, as a
        ranker joins them with a query's terms anyway. With ``stems``, ``porter:`` terms (of the list or table) too."""
        named = isinstance(terms, list)
        tf = self.in_slots(self.postings, terms) if named else self.postings
        df = self.in_slots(self.terms, terms) if named else self.terms
        tf, df = tf.select("term", "doc_id", "tf", "len"), df.select("term", "df", "cf")
        if stems and not (named and not any(t.startswith("porter:") for t in terms)):
            asked = self.spark.createDataFrame([(t,) for t in terms], "term string") if named else terms
            tf, df = tf.unionByName(self.stemmed(asked)), df.unionByName(self.stem_counts(asked))
        return tf, self.with_totals(df)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def renamed(spark: SparkSession, aside: str, path: str) -> None:
    """Give a whole folder its name, unless another driver was first."""
    fs, p = file_system(spark, path)
    if fs.exists(p) or not fs.rename(file_system(spark, aside)[1], p):
        remove(spark, aside)


def files_of(spark: SparkSession, table: str) -> tuple[list, int]:
    """Name, size and time of each data file below a path, in order; and the bytes of all."""
    fs, p = file_system(spark, table)
    walk, found = fs.listFiles(p, True), []
    while walk.hasNext():
        f = walk.next()
        name = f.getPath().getName()
        if not name.startswith(("_", ".")):
            found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(found), sum(size for _, size, _ in found)
