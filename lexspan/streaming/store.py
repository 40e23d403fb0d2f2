"""A store of annotations with snapshots: transactions, erasure, compaction, and appends from streams.

Each transaction writes its annotations as Parquet below its own id, and becomes visible when its manifest takes the next
free number. What is stored is lists: a feature, a document and intervals of it there, so a text becomes one row for each of its words
that differ, and not one for each word. Manifests are named by the number alone and published by a step that fails if the name is taken, so
of two writers that want one number the second takes the next. A reader pins the manifests that are there
when it starts and reads all their rows in one scan. Erased ranges are rows too; readers drop what lies inside one
that came later. Compaction publishes what is visible up to a snapshot as one table; later readers begin there.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspan.functions import text as tx
from lexspan.operators.intervals import gc_reduce

PLAIN = "feature string, doc_id long, p long, q long, v double"
ROWS = f"{PLAIN}, snap long"
#: Intervals p to q with values v; without q they are single places, none of them null, without v the values are 0.
LISTS = "feature string, doc_id long, p array<long>, q array<long>, v array<double>"


class Store:
    """Annotations below one folder that all workers share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))
        self._known: dict[int, dict] = {}

    def manifests(self) -> list[tuple[int, dict]]:
        """What was published, in order: (number, {"ids": transactions} or {"compacted": id, "upto": number})."""
        return [(n, self._manifest(n)) for n in self._numbers()]

    def _numbers(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/manifest"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, n: int) -> dict:
        """Published manifests never change, so each is read once."""
        if n not in self._known:
            stream = self._fs.open(self._path(f"{self.path}/manifest/{n:012d}"))
            try:
                self._known[n] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self._known[n]

    def publish(self, entry: dict) -> int:
        """The number that the entry got; it is visible as a whole or not at all."""
        draft = self._path(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        n = max(self._known, default=0) + 1
        while not self._named(draft, n):
            n = max(self._numbers()) + 1
        self._known[n] = entry
        return n

    def _named(self, draft, n: int) -> bool:
        """Give the draft its number unless that is taken. A rename fails then, but on a local disk, where a link does."""
        to = self._path(f"{self.path}/manifest/{n:012d}")
        if self._fs.getScheme() != "file":
            return not self._fs.exists(to) and bool(self._fs.rename(draft, to))
        jvm = self.spark._jvm
        local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(local(to), local(draft))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        self._fs.delete(draft, False)
        return True

    def snapshots(self) -> list[tuple[int, str]]:
        """Committed transactions in order: (number, id)."""
        return [(n, tid) for n, m in self.manifests() for tid in m.get("ids", [])]

    def transaction(self) -> Transaction:
        return Transaction(self)

    def read(self, upto: int | None = None) -> DataFrame:
        """(feature, doc_id, p, q, v, snap) as of a snapshot; None: all that is committed now."""
        return visible(single(self._stored(upto)))

    def lists(self, upto: int | None = None) -> DataFrame:
        """What ``read`` returns in lists (feature, doc_id, p, q, v, snap), as they were written. A feature of a document may have several."""
        stored = self._stored(upto)
        if stored.where("feature = ''").isEmpty():
            return stored
        left = visible(single(stored)).groupBy("feature", "doc_id", "snap").agg(F.collect_list(F.struct("p", "q", "v")).alias("at"))
        return left.select("feature", "doc_id", "at.p", "at.q", "at.v", "snap")

    def _stored(self, upto: int | None) -> DataFrame:
        """The lists of a snapshot, with the erased and the erasures."""
        found = [(n, m) for n, m in self.manifests() if upto is None or n <= upto]
        base = max(((m["upto"], m["compacted"]) for _, m in found if "compacted" in m), default=(0, None))
        later = [(n, tid) for n, m in found if n > base[0] for tid in m.get("ids", [])]
        rows = None
        if base[1] is not None:
            rows = self.spark.read.schema(ROWS).parquet(f"{self.path}/compacted/{base[1]}").select(*of_one(), "snap")
        if later:
            scan = self.spark.read.schema(f"{LISTS}, tid string").option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/tid={tid}" for _, tid in later])
            numbers = self.spark.createDataFrame([(tid, n) for n, tid in later], "tid string, snap long")
            # one row for each transaction; else all lists of a transaction would be sent to one task
            scan = scan.join(F.broadcast(numbers), "tid").drop("tid")
            rows = scan if rows is None else rows.unionByName(scan)
        return self.spark.createDataFrame([], f"{LISTS}, snap long") if rows is None else rows

    def compact(self) -> int:
        """Write what is visible now as one table; the number of the manifest. Readers of earlier snapshots and
        transactions that commit meanwhile are not affected."""
        upto, name = max((n for n, _ in self.manifests()), default=0), uuid.uuid4().hex
        # ordered by feature and document, so a frequent feature is cut between documents and no task holds it whole
        self.read(upto).orderBy("feature", "doc_id", "p").write.parquet(f"{self.path}/compacted/{name}")
        return self.publish({"compacted": name, "upto": upto})

    def commit_all(self, transactions: list[Transaction]) -> int:
        """Publish several transactions as one snapshot; all of them or none."""
        if not all(t.ready() for t in transactions):
            raise RuntimeError("commit without a yes vote")
        return self.publish({"ids": [t.id for t in transactions]})


class Transaction:
    """Writes that nobody sees before ``commit``; one that isn't ready can't commit."""

    def __init__(self, store: Store) -> None:
        self.store, self.id, self.parts, self.ready_vote = store, uuid.uuid4().hex, [], None

    def annotate(self, rows: DataFrame) -> None:
        """Rows (feature, doc_id, p, q, v) without a feature are dropped, as are reversed intervals."""
        self.parts.append(rows.where("feature is not null and feature <> '' and p <= q").select(*of_one()))

    def annotate_lists(self, lists: DataFrame) -> None:
        """The same of lists (feature, doc_id, p, q, v), where q and v may be null."""
        # single places can't be reversed, so only lists with ends are looked through
        forward = F.when(F.col("q").isNotNull(), F.filter(intervals(), lambda x: x["p"] <= x["q"]))
        rows = lists.where("feature is not null and feature <> ''").withColumn("at", forward)
        own = lambda name, other: F.when(F.col("q").isNotNull(), F.col(f"at.{name}")).otherwise(other).alias(name)
        rows = rows.select("feature", "doc_id", own("p", F.col("p")), own("q", F.col("q")), own("v", F.col("v")))
        self.parts.append(rows.where(F.size("p") > 0))

    def erase(self, ranges: DataFrame) -> None:
        """(doc_id, p, q): what lies inside one of these goes."""
        self.parts.append(ranges.withColumns({"feature": F.lit(""), "v": F.lit(0.0)}).select(*of_one()))

    def ready(self) -> bool:
        """Write all lists; the vote is remembered."""
        if self.ready_vote is None:
            rows = self.parts[0] if self.parts else self.store.spark.createDataFrame([], LISTS)
            for part in self.parts[1:]:
                rows = rows.unionByName(part)
            rows.sortWithinPartitions("feature", "doc_id", F.get("p", F.lit(0))).write.mode("overwrite").parquet(f"{self.store.path}/data/tid={self.id}")
            self.ready_vote = True
        return self.ready_vote

    def commit(self) -> int:
        """Publish; the number of the snapshot."""
        if not self.ready_vote:
            raise RuntimeError("commit without a yes vote")
        return self.store.publish({"ids": [self.id]})

    def abort(self) -> None:
        self.store._fs.delete(self.store._path(f"{self.store.path}/data/tid={self.id}"), True)
        self.parts, self.ready_vote = [], False


def of_one() -> list[Column]:
    """The columns of a row (feature, doc_id, p, q, v) as a list of one interval."""
    return [F.col("feature"), F.col("doc_id"), *(F.array(F.col(c).cast(t)).alias(c) for c, t in (("p", "long"), ("q", "long"), ("v", "double")))]


def intervals() -> Column:
    """The intervals of a list, as an array of (p, q, v)."""
    zeros = F.array_repeat(F.lit(0.0), F.size("p"))
    return F.arrays_zip("p", F.coalesce("q", "p").alias("q"), F.coalesce("v", zeros).alias("v"))


def single(lists: DataFrame) -> DataFrame:
    """A row for each interval of lists."""
    return lists.select("feature", "doc_id", "snap", F.inline(intervals()).alias("p", "q", "v")).select("feature", "doc_id", "p", "q", "v", "snap")


def visible(rows: DataFrame) -> DataFrame:
    """Rows that no later erasure holds, without the erasures.

    In each document a window in order of start carries the furthest end of the erasures begun so far; a row is gone if that
    reaches its end. Only erasures of snapshots not before the row's own count: of n snapshots that erase, in order, those
    are made up of at most log n blocks of sizes 1, 2, 4, ..., at most one of each size, so there is a window for each size, in which a
    row stands with the erasures of its block. The work grows with the rows and erasures together, and no row is compared with each erasure.
    """
    erasing = [r.snap for r in rows.where("feature = ''").select("snap").distinct().orderBy("snap").collect()]  # at most one for each manifest
    if not erasing:
        return rows.where("feature <> ''")
    size = 1 << (len(erasing) - 1).bit_length()
    top = size.bit_length() - 1
    # the place of a row's snapshot among those that erase: the first not before it
    place = F.size(F.filter(F.array(*[F.lit(n).cast("long") for n in erasing]), lambda n: n < F.col("snap")))
    found = rows.withColumns({"lexspan_at": place, "lexspan_place": place, "lexspan_gone": F.lit(False)})
    erasure = F.col("feature") == ""
    for k in range(top + 1):
        # from its place up to the end a row takes the blocks with odd places, and in the end the whole
        at = F.col("lexspan_place")
        takes = ((at % 2 == 1) | (F.lit(k == top) & (at == 0))) & (at < size >> k)
        block = F.when(erasure, F.shiftright("lexspan_at", k)).when(takes, at).otherwise(-1)
        begun = Window.partitionBy("doc_id", "lexspan_block").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        found = found.withColumn("lexspan_block", block.cast("int")).withColumn("lexspan_reach", F.max(F.when(erasure, F.col("q"))).over(begun))
        gone = F.col("lexspan_gone") | ((F.col("lexspan_block") >= 0) & F.coalesce(F.col("lexspan_reach") >= F.col("q"), F.lit(False)))
        found = found.withColumns({"lexspan_gone": gone, "lexspan_place": F.floor((at + 1) / 2).cast("int")})
    return found.where(~erasure & ~F.col("lexspan_gone")).select(*rows.columns)


def latest(rows: DataFrame) -> DataFrame:
    """Of rows of one feature at one interval the one of the latest snapshot; then minimal intervals of each feature."""
    order = Window.partitionBy("feature", "doc_id", "p", "q").orderBy(F.desc("snap"), "v")
    one = rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    # a feature of a document is a list of its own
    keyed = one.select(F.struct("feature", "doc_id").alias("doc_id"), "p", "q", "v")
    return gc_reduce(keyed).select("doc_id.feature", "doc_id.doc_id", "p", "q", "v")


def token_rows(docs: DataFrame) -> DataFrame:
    """Documents as annotation rows: one a token, and ``:item`` over each document."""
    tokens = tx.tokens(docs).select(F.col("term").alias("feature"), "doc_id", F.col("pos").alias("p"), F.col("pos").alias("q"), F.lit(0.0).alias("v"))
    n = F.size(tx.words(F.col("text"))).cast("long")
    items = docs.select(F.lit(":item").alias("feature"), "doc_id", F.lit(0).cast("long").alias("p"), (n - 1).alias("q"), F.lit(0.0).alias("v")).where("q >= 0")
    return tokens.unionByName(items)


def _annotated(batches):
    """The rows of ``token_lists`` of batches (id, text in lower case)."""
    for words in tx._counted(batches):
        term, doc, length, places = (words.column(k) for k in (0, 1, 3, 4))
        p = places.flatten().cast(pa.int64())
        first = pc.equal(pc.list_element(places, 0), 0)
        # one word of each document stands at its start
        doc_ends = pc.subtract(length.filter(first), 1).cast(pa.int64())
        items = len(doc_ends)
        one = pa.array(np.arange(items + 1), pa.int32())
        starts = pa.ListArray.from_arrays(one, pa.array(np.zeros(items, np.int64)))
        yield from (_lists(term, doc, pa.ListArray.from_arrays(places.offsets, p)), _lists(pa.array([":item"] * items), doc.filter(first), starts, pa.ListArray.from_arrays(one, doc_ends)))


def _lists(feature: pa.Array, doc: pa.Array, p: pa.Array, q: pa.Array | None = None) -> pa.RecordBatch:
    q = pa.nulls(len(p), p.type) if q is None else q
    return pa.RecordBatch.from_arrays([feature, doc, p, q, pa.nulls(len(p), pa.list_(pa.float64()))], ["feature", "doc_id", "p", "q", "v"])


def token_lists(docs: DataFrame) -> DataFrame:
    """``token_rows`` in lists (feature, doc_id, p, q, v): one for each word of a row (doc_id, text), and one for ``:item``. Texts are cut once and nothing is shuffled."""
    return docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).mapInArrow(_annotated, LISTS)


def append_stream(stream: DataFrame, store: Store, checkpoint: str):
    """A streaming query that commits each micro-batch of (doc_id, text) as one snapshot."""

    def commit(batch: DataFrame, _: int) -> None:
        t = store.transaction()
        t.annotate_lists(token_lists(batch))
        t.ready()
        t.commit()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).start()


def batch_of(doc_id: Column, batches: int) -> Column:
    """The batch a document belongs to when a table is appended in parts."""
    return F.pmod(doc_id, F.lit(batches)).cast("long")
