"""Helpers that several operators share: workspace tables, batch maps, row keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces in which a batch is worked on, so that Python's memory doesn't follow the batch size.
PIECE_BYTES = 1 << 19
#: Rows of an Arrow batch.
BATCH_ROWS = 500
#: Makes Spark delete the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine that names none, as in tests, gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="lexspan-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the workspace and read it back: the lineage ends here
    and a lost executor costs a re-read, not a recomputation. The shuffle files behind it go at once,
    the table with ``forget`` or when the driver ends."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lexspan_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for t in tables:
        drop(t.sparkSession, t.lexspan_path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a workspace table; at the driver's end the session may be gone already."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  nothing depends on it
        return


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose tasks hand back the memory that they no longer use, as Python workers go from
    one stage to the next and would keep the most that any of them took."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Free memory of ended work back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Rows may be long texts, so Arrow batches of the session are made small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or binary array with about ``most`` bytes each."""
    import pyarrow.compute as pc

    n, start, held = len(texts), 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < n:
        yield start, n


def append_columns(
    docs: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
) -> DataFrame:
    """``docs`` with ``fields`` after its columns, each computed from the text alone.

    A column of the table with a field's name gives way to the field. ``make`` runs once in each task and returns the function from an Arrow array of texts to one
    array for each field. Rows pass in order; all other columns go through untouched.
    """
    kept = [f for f in docs.schema.fields if f.name not in {g.name for g in fields}]
    docs = docs.select(*[f.name for f in kept])
    schema = T.StructType([*kept, *fields])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for a, b in pieces(batch.column(at)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part.column(at))], [f.name for f in schema.fields])

    return arrow_map(docs, run, schema)


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart; equal rows share it."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, mod ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def least_of(links: DataFrame) -> DataFrame:
    """(u, m): the least v of each u, grouped by a struct, so that a join back deals the links anew and
    Spark can split those of one end."""
    return links.groupBy(F.struct("u").alias("lexspan_key")).agg(F.min("v").alias("m")).select("lexspan_key.u", "m")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Alternating large-star and small-star steps, each a grouping of links by one end, until no
    link changes; the rounds grow with the logarithm of the number of nodes. A star's centre may
    have any number of links: minima are aggregated before the shuffle and joined back, so no
    group of links is held in one place. Links are written between rounds.
    """
    links = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = links.union(links.select("v", "u").toDF("u", "v"))
        # large star: neighbours above u hang from the least of u and its neighbours
        least = least_of(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its neighbours below hang from the least of them
        low = least_of(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        same = after.count() == links.count() and after.exceptAll(links).isEmpty()
        forget(links)
        links = after
        if same:
            break
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return found.union(roots)
