"""Tables, and SQL fragments that the oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.plans.engine import StoredEngine
from lexspan.sources.postings import Postings

#: Terms of the sample queries.
A, B, C, D = "with", "was", "from", "that"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, stem: bool = False) -> StoredEngine:
    """The engine over the stored index of the documents, which the first query of a table builds."""
    index = Postings.stored(spark, f"{sf_dir}/documents.parquet")
    return StoredEngine(index, table(spark, sf_dir, "documents").select("doc_id", "text"), stem=stem)


def spans(rows: DataFrame) -> DataFrame:
    """Interval lists as results."""
    return rows.select("doc_id", "p", "q")


TOK = """tok AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t)))::BIGINT AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents))"""
WORDS = "said AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)"
TF = "tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
DF = "df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY ALL)"
LEN = "dl AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY ALL)"
TOTAL = "total AS (SELECT count(DISTINCT doc_id) AS items, count(*) AS length, count(DISTINCT term) AS vocab, count(*) / count(DISTINCT doc_id) AS avgl FROM tok)"
STATS = ", ".join([TOK, TF, DF, LEN, TOTAL])
RSJ = "greatest(0, ln((items - df + 0.5) / (df + 0.5)))"
QUERY = """topic_terms AS (SELECT item_id AS topic, term, count(*)::DOUBLE AS weight FROM
  (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL)"""


def term_list(name: str, term: str) -> str:
    return f"{name} AS (SELECT doc_id, pos AS p, pos AS q FROM tok WHERE term = '{term}')"


def reduced(rows: str) -> str:
    """Of the candidate intervals of ``rows`` those that contain no other."""
    return f"""SELECT doc_id, p, q FROM (SELECT doc_id, p, q, min(q) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
  FROM (SELECT doc_id, p, min(q) AS q FROM ({rows}) GROUP BY ALL)) WHERE later IS NULL OR q < later"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


BOTH = "SELECT x.doc_id, least(x.p, y.p) AS p, greatest(x.q, y.q) AS q FROM {0} x JOIN {1} y USING (doc_id)"
THEN = "SELECT x.doc_id, x.p, y.q FROM {0} x JOIN {1} y ON x.doc_id = y.doc_id AND x.q < y.p"


def id_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
