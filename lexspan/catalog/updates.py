"""Transactions, snapshots, erasure, enrichment and incremental statistics over annotation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.catalog._tables import DF, TF, TOK, A, B, table, with_
from lexspan.operators import ranking as rk
from lexspan.registry import register
from lexspan.sources.workspace import file_system, passing_folder
from lexspan.streaming import statistics as sm
from lexspan.streaming import store as st


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the driver ends."""
    return passing_folder(spark, "store")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@register("build_index", with_(TOK, select="SELECT term AS feature, count(*) AS n, count(DISTINCT doc_id) AS df FROM tok GROUP BY term UNION ALL SELECT ':item', count(DISTINCT doc_id), count(DISTINCT doc_id) FROM tok"))
def build_index(spark, sf_dir):
    """All documents as one transaction, read back."""
    from lexspan.functions.text import one_row_each

    store, docs = st.Store(spark, folder(spark)), documents(spark, sf_dir)
    t = store.transaction()
    t.annotate_lists(st.token_lists(docs))
    t.ready()
    t.commit()
    # of documents that are one row each a feature has one list in each; else ids are counted once
    df = F.count("doc_id") if one_row_each(docs) else F.countDistinct("doc_id")
    return store.lists().groupBy("feature").agg(F.when(F.col("feature") == ":item", df).otherwise(F.sum(F.size("p").cast("long"))).alias("n"), df.alias("df"))


def in_batches(spark, sf_dir, batches: int) -> tuple[st.Store, list[int]]:
    """The places of two terms, committed in parts."""
    store, snaps = st.Store(spark, folder(spark)), []
    rows = st.token_rows(documents(spark, sf_dir)).where(F.col("feature").isin(A, B))
    for k in range(batches):
        t = store.transaction()
        t.annotate(rows.where(st.batch_of(F.col("doc_id"), batches) == k))
        t.ready()
        snaps.append(t.commit())
    return store, snaps


@register("snapshot_read", with_(TOK, select=f"SELECT term AS feature, count(*) AS n FROM tok WHERE term IN ('{A}', '{B}') AND doc_id % 3 < 2 GROUP BY term"))
def snapshot_read(spark, sf_dir):
    """A reader that pinned the second of three snapshots sees two parts."""
    store, snaps = in_batches(spark, sf_dir, 3)
    return store.read(snaps[1]).groupBy("feature").agg(F.count("*").alias("n"))


@register("txn_visibility", with_(TOK, select=f"SELECT term AS feature, count(*) AS n FROM tok WHERE term IN ('{A}', '{B}') GROUP BY term"))
def txn_visibility(spark, sf_dir):
    """A transaction that is ready but not committed, and one that was aborted, aren't seen."""
    store, _ = in_batches(spark, sf_dir, 2)
    ghost = spark.createDataFrame([("ghost", 1, 0, 0, 0.0)], "feature string, doc_id long, p long, q long, v double")
    for end in ("ready", "abort"):
        t = store.transaction()
        t.annotate(ghost)
        t.ready()
        if end == "abort":
            t.abort()
    return store.read().groupBy("feature").agg(F.count("*").alias("n"))


@register("erase_range", with_(TOK, select=f"SELECT term AS feature, count(*) AS n FROM tok WHERE term IN ('{A}', '{B}') AND pos >= 50 GROUP BY term"))
def erase_range(spark, sf_dir):
    """The first fifty places of each document are erased."""
    store, _ = in_batches(spark, sf_dir, 2)
    t = store.transaction()
    t.erase(documents(spark, sf_dir).select("doc_id", F.lit(0).cast("long").alias("p"), F.lit(49).cast("long").alias("q")))
    t.ready()
    t.commit()
    return store.read().groupBy("feature").agg(F.count("*").alias("n"))


@register("update_conflict", "SELECT concat('user=', user_id % 10) AS feature, user_id AS doc_id, arg_max(value, event_id) AS v FROM events GROUP BY user_id")
def update_conflict(spark, sf_dir):
    """Several annotations of one interval: the latest wins."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("user="), (F.col("user_id") % 10).cast("string")).alias("feature"), F.col("user_id").alias("doc_id"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.col("value").alias("v"), F.col("event_id").alias("snap"))
    return st.latest(rows).select("feature", "doc_id", "v")


@register("incremental_stats", with_(TOK, TF, DF, select="SELECT term, df, cf FROM df"))
def incremental_stats(spark, sf_dir):
    """Statistics of each part alone, summed on read."""
    from lexspan.functions.text import tokens

    docs, parts = documents(spark, sf_dir), None
    for k in range(3):
        own = rk.document_frequencies(rk.term_frequencies(tokens(docs.where(st.batch_of(F.col("doc_id"), 3) == k))))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


@register("stream_statistics", with_(TOK, TF, DF, "n AS (SELECT count(DISTINCT doc_id) AS items, count(*) AS length FROM tok)", select="SELECT term, df, cf, items, length FROM df, n"))
def stream_statistics(spark, sf_dir):
    """The statistics that a stream of the documents has kept when it has caught up."""
    path = folder(spark)
    fs, p = file_system(spark, f"{sf_dir}/documents.parquet")
    reader = spark.readStream.schema("doc_id long, text string")
    # a stream reads folders: of a table that is one file, the folder with that name picked
    stream = reader.option("pathGlobFilter", p.getName()).parquet(sf_dir) if fs.isFile(p) else reader.parquet(f"{sf_dir}/documents.parquet")
    sm.keep_statistics(stream, f"{path}/counts", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return sm.statistics_now(spark, f"{path}/counts").drop("avgl")


@register("forage_tfidf", with_(TOK, TF, DF, select="SELECT concat('@tf-idf:', term) AS feature, doc_id, round(tf * ln((SELECT count(DISTINCT doc_id) FROM tok) / df), 6) AS v FROM tf JOIN df USING (term)"))
def forage_tfidf(spark, sf_dir):
    """tf-idf weights of all terms as annotations."""
    from lexspan.functions.text import frequencies

    tf = frequencies(documents(spark, sf_dir))
    # what has a word at all is an item; a null id, which counts as none, is not
    items = tf.agg(F.countDistinct("doc_id").alias("items"))
    df = rk.document_frequencies(tf).crossJoin(F.broadcast(items))
    v = F.round(F.col("tf") * F.log(F.col("items") / F.col("df")), 6)
    return tf.join(df, "term").select(*note(F.col("term"), v))


def note(name: Column, v: Column) -> tuple[Column, Column, Column]:
    """A forager's annotation at the start of a document."""
    return F.concat(F.lit("@tf-idf:"), name).alias("feature"), F.col("doc_id"), v.cast("double").alias("v")


@register("forage_stats")
def forage_stats(spark, sf_dir):
    """The forager's tf and df of all stems, and its totals, as annotations; df and totals stand at the first document."""
    from lexspan.functions.text import frequencies, stems

    tf = frequencies(documents(spark, sf_dir))
    stemmed = tf.join(stems(tf), "term").groupBy("doc_id", "stem").agg(F.sum("tf").alias("tf"))
    first = F.broadcast(tf.agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("items"), F.coalesce(F.sum("tf"), F.lit(0)).alias("length")))
    dfs = stemmed.groupBy("stem").agg(F.count("*").alias("df")).crossJoin(first)
    sums = first.where("items > 0").select("doc_id", F.explode(F.create_map(F.lit("items"), "items", F.lit("length"), "length")).alias("name", "n"))
    return (
        stemmed.select(*note(F.concat(F.lit("tf:"), "stem"), F.col("tf")))
        .unionByName(dfs.select(*note(F.concat(F.lit("df:"), "stem"), F.col("df"))))
        .unionByName(sums.select(*note(F.concat(F.lit("total:"), "name"), F.col("n"))))
    )
