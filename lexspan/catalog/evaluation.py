"""Retrieval metrics: topics are sources of documents, grades come from the labels, runs from their lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspan.catalog._tables import table, with_
from lexspan.operators import evaluation as ev
from lexspan.registry import register

DEPTH = 30
QRELS = "qrels AS (SELECT source AS topic, doc_id, (quality + 2 * toxic)::DOUBLE AS grade FROM documents JOIN labels USING (doc_id))"
RUN = f"run AS (SELECT topic, doc_id, len, rank FROM (SELECT source AS topic, doc_id, n_chars // 6 AS len, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= {DEPTH})"
TWO = f"two AS (SELECT topic, doc_id, rank FROM (SELECT source AS topic, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars % 100, doc_id) AS rank FROM documents) WHERE rank <= {DEPTH})"
JUDGED = "j AS (SELECT run.*, coalesce(grade, 0) AS grade, sum((coalesce(grade, 0) > 0)::INT) OVER (PARTITION BY topic ORDER BY rank) AS hits FROM run LEFT JOIN qrels USING (topic, doc_id))"
NEED = "need AS (SELECT topic, sum((grade > 0)::BIGINT)::BIGINT AS rel FROM qrels GROUP BY topic)"
BASE = (QRELS, RUN, JUDGED, NEED)


def qrels(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("source").alias("topic"), "doc_id", (F.col("quality") + 2 * F.col("toxic")).cast("double").alias("grade"))


def run_by(spark, sf_dir, *order) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), "doc_id", "n_chars", F.expr("n_chars div 6").alias("len"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(*order, "doc_id"))
    return docs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= DEPTH).select("topic", "doc_id", "len", "rank")


def run(spark, sf_dir) -> DataFrame:
    return run_by(spark, sf_dir, F.desc("n_chars"))


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@register("eval_ap", with_(*BASE, select="SELECT topic, round(sum(CASE WHEN grade > 0 THEN hits / rank ELSE 0 END) / any_value(rel), 6) AS ap FROM j JOIN need USING (topic) GROUP BY topic HAVING any_value(rel) > 0"))
def eval_ap(spark, sf_dir):
    return rounded(ev.precision_metrics(run(spark, sf_dir), qrels(spark, sf_dir)).where("rel > 0").select("topic", "ap"))


@register("eval_rr", with_(*BASE, select="SELECT topic, round(coalesce(1 / min(CASE WHEN grade > 0 THEN rank END), 0), 6) AS rr FROM j JOIN need USING (topic) GROUP BY topic"))
def eval_rr(spark, sf_dir):
    return rounded(ev.precision_metrics(run(spark, sf_dir), qrels(spark, sf_dir)).select("topic", "rr"))


@register("eval_prec", with_(*BASE, select="SELECT topic, round(sum((grade > 0 AND rank <= 5)::INT) / 5, 6) AS p05, round(sum((grade > 0 AND rank <= 10)::INT) / 10, 6) AS p10, round(sum((grade > 0 AND rank <= 20)::INT) / 20, 6) AS p20, count(*) AS ret, any_value(rel) AS rel, sum((grade > 0)::BIGINT)::BIGINT AS rel_ret, round(sum((grade > 0)::INT) / count(*), 6) AS \"precision\", round(CASE WHEN any_value(rel) > 0 THEN sum((grade > 0)::INT) / any_value(rel) ELSE 0 END, 6) AS recall FROM j JOIN need USING (topic) GROUP BY topic"))
def eval_prec(spark, sf_dir):
    return rounded(ev.precision_metrics(run(spark, sf_dir), qrels(spark, sf_dir)).drop("ap", "rr"))


@register("eval_ndcg", with_(*BASE, "ideal AS (SELECT topic, grade, row_number() OVER (PARTITION BY topic ORDER BY grade DESC, doc_id) AS rank FROM qrels WHERE grade > 0)", "b AS (SELECT topic, sum(grade * ln(2) / ln(rank + 1)) AS best, sum(CASE WHEN rank <= 10 THEN grade * ln(2) / ln(rank + 1) ELSE 0 END) AS best10 FROM ideal GROUP BY topic)", select="SELECT topic, round(sum(grade * ln(2) / ln(rank + 1)), 6) AS dcg, round(sum(grade * ln(2) / ln(rank + 1)) / any_value(best), 6) AS ndcg, round(sum(CASE WHEN rank <= 10 THEN grade * ln(2) / ln(rank + 1) ELSE 0 END) / any_value(best10), 6) AS ndcg10 FROM j JOIN b USING (topic) GROUP BY topic"))
def eval_ndcg(spark, sf_dir):
    found = ev.ndcg_metrics(run(spark, sf_dir), qrels(spark, sf_dir))
    has = qrels(spark, sf_dir).where("grade > 0").select("topic").distinct()
    return rounded(found.join(has, "topic", "left_semi").select("topic", "dcg", "ndcg", "ndcg10"))


@register("eval_rbp", with_(*BASE, select="SELECT topic, round(0.5 * sum(CASE WHEN grade > 0 THEN pow(0.5, rank - 1) ELSE 0 END), 6) AS rbp50, round(0.05 * sum(CASE WHEN grade > 0 THEN pow(0.95, rank - 1) ELSE 0 END), 6) AS rbp95 FROM j GROUP BY topic"))
def eval_rbp(spark, sf_dir):
    return rounded(ev.rbp_metrics(run(spark, sf_dir), qrels(spark, sf_dir)))


@register("eval_tbg", with_(*BASE, "c AS (SELECT *, 4.4 + (0.018 * len + 7.8) * CASE WHEN grade > 0 THEN 0.64 ELSE 0.39 END AS cost FROM j)", "s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY topic ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c)", select="SELECT topic, round(sum(CASE WHEN grade > 0 THEN 0.64 * 0.77 * exp(-spent * ln(2) / 224.0) ELSE 0 END), 6) AS tbg FROM s GROUP BY topic"))
def eval_tbg(spark, sf_dir):
    return rounded(ev.time_biased_gain(run(spark, sf_dir), qrels(spark, sf_dir)))


HALF = "sum(CASE WHEN {a} IS NOT NULL AND ({b} IS NULL OR {a} <= {b}) THEN {f} ELSE 0 END)"


def _half(a: str, b: str, f: str) -> str:
    own, other = f.format(r=a), f"coalesce({f.format(r=b)}, 0)"
    return HALF.format(a=a, b=b, f=f"{own} - {other}")


_DCG, _R50, _R95 = "ln(2) / ln({r} + 1)", "0.5 * pow(0.5, {r} - 1)", "0.05 * pow(0.95, {r} - 1)"
_BEST = {n: f"greatest({_half('r1', 'r2', f)}, {_half('r2', 'r1', f)})" for n, f in (("med_dcg", _DCG), ("med_rbp50", _R50), ("med_rbp95", _R95))}


@register("eval_med", with_(RUN, TWO, "both_ AS (SELECT topic, doc_id, run.rank AS r1, two.rank AS r2 FROM run FULL JOIN two USING (topic, doc_id))", select=f"SELECT topic, {', '.join(f'round({e}, 6) AS {n}' for n, e in _BEST.items())} FROM both_ GROUP BY topic"))
def eval_med(spark, sf_dir):
    return rounded(ev.effectiveness_difference(run(spark, sf_dir), run_by(spark, sf_dir, F.col("n_chars") % 100)).drop("med_ndcg"))


@register("metric_mean", with_(*BASE, "m AS (SELECT topic, 0.5 * sum(CASE WHEN grade > 0 THEN pow(0.5, rank - 1) ELSE 0 END) AS rbp50, 0.05 * sum(CASE WHEN grade > 0 THEN pow(0.95, rank - 1) ELSE 0 END) AS rbp95 FROM j GROUP BY topic)", select="SELECT 'rbp50' AS metric, round(avg(rbp50), 6) AS mean, count(*) AS topics FROM m UNION ALL SELECT 'rbp95', round(avg(rbp95), 6), count(*) FROM m"))
def metric_mean(spark, sf_dir):
    return rounded(ev.means(ev.rbp_metrics(run(spark, sf_dir), qrels(spark, sf_dir))))


@register("qrels_norm", with_(QRELS, select="SELECT topic, doc_id, round((pow(2, greatest(grade, 0)) - 1) / pow(2, (SELECT max(greatest(grade, 0)) FROM qrels)), 6) AS grade FROM qrels"))
def qrels_norm(spark, sf_dir):
    return rounded(ev.rescaled_grades(qrels(spark, sf_dir)))


@register("qrel_annotations", "SELECT concat('qrel:', source) AS feature, doc_id, 0::BIGINT AS p, n_chars AS q, (quality + 2 * toxic)::DOUBLE AS v FROM documents JOIN labels USING (doc_id)")
def qrel_annotations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("q"))
    return qrels(spark, sf_dir).join(docs, "doc_id").select(F.concat(F.lit("qrel:"), "topic").alias("feature"), "doc_id", F.lit(0).cast("long").alias("p"), "q", F.col("grade").alias("v"))


@register("trec_run", with_(RUN, select="SELECT concat_ws(' ', topic, 'Q0', concat('doc-', doc_id), rank, 1000 - rank, 'sample') AS line FROM run"))
def trec_run(spark, sf_dir):
    rows = run(spark, sf_dir)
    return rows.select(F.concat_ws(" ", "topic", F.lit("Q0"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("rank").cast("string"), (1000 - F.col("rank")).cast("string"), F.lit("sample")).alias("line"))


@register("trec_docno", "SELECT page_id, regexp_extract(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\"'']', '', 'g'), '[^ \\t\\n\\r]+') AS docno FROM pages")
def trec_docno(spark, sf_dir):
    plain = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[\"']", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(plain, "[^ \\t\\n\\r]+", 0).alias("docno"))


@register("judged_compile", with_(QRELS, RUN, "g AS (SELECT run.topic, run.doc_id, rank, coalesce(grade, 0) AS grade FROM run LEFT JOIN qrels USING (topic, doc_id))", "s AS (SELECT *, min(CASE WHEN bad = 5 THEN rank END) OVER (PARTITION BY topic) AS stop FROM (SELECT *, sum((grade < 1)::INT) OVER (PARTITION BY topic ORDER BY rank ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS bad FROM g))", select="SELECT topic, doc_id, grade, row_number() OVER (PARTITION BY topic ORDER BY grade DESC, rank) AS rank FROM s WHERE stop IS NULL OR rank <= stop"))
def judged_compile(spark, sf_dir):
    """A list stops after five documents in a row that aren't relevant, and is sorted by grade."""
    rows = ev.judged(run(spark, sf_dir).drop("len"), qrels(spark, sf_dir))
    bad = F.sum((F.col("grade") < 1).cast("int")).over(Window.partitionBy("topic").orderBy("rank").rowsBetween(-4, 0))
    stop = F.min(F.when(F.col("bad") == 5, F.col("rank"))).over(Window.partitionBy("topic"))
    kept = rows.withColumn("bad", bad).withColumn("stop", stop).where("stop is null or rank <= stop")
    order = Window.partitionBy("topic").orderBy(F.desc("grade"), "rank")
    return kept.select("topic", "doc_id", "grade", F.row_number().over(order).cast("long").alias("rank"))
