"""Aggregates over nested records: JSON fields of events, arrays of orders, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.catalog._tables import table
from lexspan.registry import register

K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))


@register("json_min_avg_max", f"SELECT event_type, min({K}) AS least, round(avg({K}), 6) AS mean, max({K}) AS most FROM events GROUP BY event_type")
def json_min_avg_max(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.min("k").alias("least"), F.round(F.avg("k"), 6).alias("mean"), F.max("k").alias("most"))


@register("json_count_exact", f"SELECT count(*) AS n FROM events WHERE {K} = 42")
def json_count_exact(spark, sf_dir):
    return events(spark, sf_dir).where("k = 42").agg(F.count("*").alias("n"))


@register("json_count", "SELECT count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, count(DISTINCT user_id) AS users FROM events")
def json_count(spark, sf_dir):
    return events(spark, sf_dir).agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.countDistinct("user_id").alias("users"))


@register("json_group_count", f"SELECT event_type, {K} AS k, count(*) AS n FROM events GROUP BY ALL")
def json_group_count(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@register("json_value_filter", f"SELECT event_id, {K} AS k FROM events WHERE {K} BETWEEN 10 AND 20")
def json_value_filter(spark, sf_dir):
    return events(spark, sf_dir).where("k between 10 and 20").select("event_id", "k")


@register("json_explode", "SELECT l_orderkey AS id, concat(':lines:[', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1, ']:part:') AS path, l_partkey AS part FROM lineitem")
def json_explode(spark, sf_dir):
    """Orders as records with an array of lines, exploded with the place of each line."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(line))).alias("json"))
    lines = F.from_json("json", "array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint>>")
    rows = orders.select(F.col("l_orderkey").alias("id"), F.posexplode(lines).alias("i", "line"))
    return rows.select("id", F.concat(F.lit(":lines:["), F.col("i").cast("string"), F.lit("]:part:")).alias("path"), F.col("line.l_partkey").alias("part"))


@register("date_tags", "SELECT event_id, concat('year=', year(ts)) AS year_tag, concat('month=', month(ts)) AS month_tag, concat('day=', day(ts)) AS day_tag FROM events")
def date_tags(spark, sf_dir):
    """Dates in three notations become tags of one form."""
    rows = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.date_format("ts", "d MMM yyyy"))
    parsed = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "d MMM yyyy")])
    tag = lambda name, f: F.concat(F.lit(f"{name}="), f(parsed).cast("string")).alias(f"{name}_tag")
    return rows.select("event_id", tag("year", F.year), tag("month", F.month), tag("day", F.dayofmonth))


@register("json_date_count", "SELECT kind, y, count(*) AS n FROM (SELECT 'event' AS kind, year(ts)::BIGINT AS y FROM events UNION ALL SELECT 'order', year(o_orderdate)::BIGINT FROM orders UNION ALL SELECT 'line', year(l_shipdate)::BIGINT FROM lineitem) GROUP BY ALL")
def json_date_count(spark, sf_dir):
    """Records of three schemas counted by the year of their dates."""
    part = lambda name, col, kind: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.year(col).cast("long").alias("y"))
    rows = part("events", "ts", "event").unionByName(part("orders", "o_orderdate", "order")).unionByName(part("lineitem", "l_shipdate", "line"))
    return rows.groupBy("kind", "y").agg(F.count("*").alias("n"))


@register("record_totals", "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL")
def record_totals(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
