"""Ingestion of the driver's tables as the formats the engine reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.catalog._tables import TOK, table, with_
from lexspan.functions import text as tx
from lexspan.operators import intervals as iv
from lexspan.registry import register
from lexspan.sources import ingest as src

WORD = "[A-Za-z0-9]"


@register("jsonl_index", f"SELECT doc_id::VARCHAR AS docno, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens FROM documents WHERE regexp_matches(text, '{WORD}')")
def jsonl_index(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("docid"), F.col("text").alias("contents"))).alias("value"))
    return src.jsonl_documents(lines).select("docno", F.size(tx.words(F.col("text"))).cast("long").alias("n_tokens"))


@register("json_paths", "SELECT event_id AS id, ':' AS path, 'object' AS kind, 0::DOUBLE AS v, '' AS said FROM events UNION ALL SELECT event_id, ':k:', 'number', CAST(json_extract_string(props, '$.k') AS DOUBLE), concat(json_extract_string(props, '$.k'), '.000000') FROM events UNION ALL SELECT event_id, 'k:', 'key', 0, '' FROM events")
def json_paths(spark, sf_dir):
    return src.json_paths(table(spark, sf_dir, "events"), "event_id", "props")


@register("jsonl_append", "SELECT conv_id AS id, ':role:' AS path, count(*) AS n FROM conversations GROUP BY ALL UNION ALL SELECT conv_id, ':turn:', count(*) FROM conversations GROUP BY ALL UNION ALL SELECT conv_id, ':', count(*) FROM conversations GROUP BY ALL")
def jsonl_append(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.to_json(F.struct("turn", "role")).alias("value"))
    return src.json_paths(lines, "conv_id", "value").where("kind <> 'key'").groupBy("id", "path").agg(F.count("*").alias("n"))


@register("tsv_columns", "SELECT n_nationkey::BIGINT AS id, ':0:' AS feature, n_nationkey::VARCHAR AS said FROM nation UNION ALL SELECT n_nationkey, ':1:', n_name FROM nation UNION ALL SELECT n_nationkey, ':2:', n_regionkey::VARCHAR FROM nation")
def tsv_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("line"))
    return src.tsv_columns(lines, "id", "line")


@register("already_appended", "SELECT page_id, url AS path FROM pages WHERE page_id % 3 <> 0")
def already_appended(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    known = pages.where("page_id % 3 = 0").select(F.concat(F.lit("  "), "path", F.lit(" ")).alias("path"))
    mine = pages.select("page_id", F.concat("path", F.lit("#"), F.col("page_id").cast("string")).alias("path"))
    sources = known.join(pages.where("page_id % 3 = 0").select("page_id", F.col("path").alias("own")), F.trim("path") == F.col("own")).select(F.concat(F.lit(" "), "own", F.lit("#"), F.col("page_id").cast("string")).alias("path"))
    return src.not_yet(mine, sources).select("page_id", F.regexp_replace("path", "#[0-9]+$", "").alias("path"))


@register("docno_dupes", "SELECT source AS docno, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def docno_dupes(spark, sf_dir):
    return src.duplicate_docnos(table(spark, sf_dir, "documents"), "source")


@register("load_trec", "SELECT doc_id::VARCHAR AS docno, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS n FROM documents")
def load_trec(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.concat(F.lit("<DOC>\n<DOCNO> "), F.col("doc_id").cast("string"), F.lit(" </DOCNO>\n"), "text", F.lit("\n</DOC>\n")).alias("value"))
    return src.trec_documents(texts).select("docno", F.length(F.regexp_replace("body", "[^A-Za-z0-9]", "")).cast("long").alias("n"))


@register("load_files", "SELECT url AS path, 'content:' AS feature, length(html) AS n FROM pages UNION ALL SELECT url, 'filename:', length(url) FROM pages UNION ALL SELECT url, 'file:', length(url) + 1 + length(html) FROM pages")
def load_files(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("value"))
    return src.file_features(files).select("path", "feature", F.length("said").cast("long").alias("n"))


@register("load_c4_like", f"SELECT url, len(regexp_extract_all(html, '{WORD}+')) AS n_words FROM pages")
def load_c4_like(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").select(F.to_json(F.struct("url", F.col("html").alias("text"))).alias("value"))
    rows = src.jsonl_documents(lines, "url", "text")
    return rows.select(F.col("docno").alias("url"), F.size(tx.ascii_words(F.col("text"))).cast("long").alias("n_words"))


@register("sparse_annotate", with_(TOK, select="SELECT doc_id::VARCHAR AS docid, concat('splade:', term) AS feature, count(*) AS v FROM tok GROUP BY ALL"))
def sparse_annotate(spark, sf_dir):
    """Vectors of all words of all documents, written as JSON lines and read as annotations."""
    counts = tx.frequencies(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("tf", "n")
    lines = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("splade_vector")).select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("docid"), "splade_vector")).alias("value"))
    return src.sparse_vectors(lines)


XML = "regexp_replace(html, '&[A-Za-z0-9#]+;', ' ', 'g')"
XTOK = f"xtok AS (SELECT doc_id, regexp_replace(unnest(t), '^(</?[A-Za-z][A-Za-z0-9]*)[^>]*>$', '\\1>') AS term, unnest(range(len(t)))::BIGINT AS pos FROM (SELECT page_id AS doc_id, regexp_extract_all({XML}, '(</?[A-Za-z][^<>\\n]*>|[A-Za-z0-9]+)', 1) AS t FROM pages))"


def xml_list(spark, sf_dir, term: str):
    tokens = tx.tokens(table(spark, sf_dir, "pages"), "html", "page_id", tx.xml_words)
    return tokens.where(F.col("term") == term).select("doc_id", F.col("pos").alias("p"), F.col("pos").alias("q"), F.lit(0.0).alias("v"))


@register("annotate_ranges", with_(XTOK, select="SELECT x.doc_id, max(x.pos) AS p, y.pos AS q FROM xtok x JOIN xtok y ON x.doc_id = y.doc_id AND x.pos < y.pos WHERE x.term = '<p>' AND y.term = '</p>' GROUP BY x.doc_id, y.pos").replace("SELECT x.doc_id, max(x.pos) AS p, y.pos AS q FROM", "SELECT doc_id, p, min(q) AS q FROM (SELECT x.doc_id, max(x.pos) AS p, y.pos AS q FROM") + ") GROUP BY doc_id, p")
def annotate_ranges(spark, sf_dir):
    """Paragraphs of pages as ranges of a feature."""
    return iv.followed_by(xml_list(spark, sf_dir, "<p>"), xml_list(spark, sf_dir, "</p>")).select("doc_id", "p", "q")


@register("extract_fields", with_(XTOK, select="SELECT o.doc_id, string_agg(t.term, ' ' ORDER BY t.pos) AS title FROM (SELECT doc_id, min(pos) AS pos FROM xtok WHERE term = '<title>' GROUP BY doc_id) o JOIN (SELECT doc_id, min(pos) AS pos FROM xtok WHERE term = '</title>' GROUP BY doc_id) c USING (doc_id) JOIN xtok t ON t.doc_id = o.doc_id AND t.pos > o.pos AND t.pos < c.pos GROUP BY o.doc_id"))
def extract_fields(spark, sf_dir):
    """The first title of each page."""
    spans = iv.followed_by(xml_list(spark, sf_dir, "<title>"), xml_list(spark, sf_dir, "</title>"))
    first = spans.groupBy("doc_id").agg(F.min(F.struct("p", "q")).alias("s")).select("doc_id", "s.p", "s.q")
    words = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), tx.xml_words(F.col("html")).alias("words"))
    said = F.array_join(F.slice("words", (F.col("p") + 2).cast("int"), (F.col("q") - F.col("p") - 1).cast("int")), " ")
    return first.where("q > p + 1").join(words, "doc_id").select("doc_id", said.alias("title"))


@register("pref_triples", "WITH p AS (SELECT b.item_id AS topic, 2 * b.item_id AS first, 2 * b.item_id + 1 AS second, b.item_id % 2 AS best, b.text AS question FROM benchmark b) SELECT topic, question, CASE best WHEN 0 THEN x.text ELSE y.text END AS best, CASE best WHEN 0 THEN y.text ELSE x.text END AS worst FROM p JOIN documents x ON x.doc_id = first JOIN documents y ON y.doc_id = second")
def pref_triples(spark, sf_dir):
    """Preferences between two documents of a topic as (question, best text, worst text)."""
    docs = table(spark, sf_dir, "documents")
    prefs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), F.col("text").alias("question"), (2 * F.col("item_id")).alias("first"), (2 * F.col("item_id") + 1).alias("second"), (F.col("item_id") % 2).alias("won"))
    text = lambda c, n: docs.select(F.col("doc_id").alias(c), F.col("text").alias(n))
    rows = prefs.join(text("first", "a"), "first").join(text("second", "b"), "second")
    return rows.select("topic", "question", F.when(F.col("won") == 0, F.col("a")).otherwise(F.col("b")).alias("best"), F.when(F.col("won") == 0, F.col("b")).otherwise(F.col("a")).alias("worst"))


@register("query_lines", "SELECT item_id::VARCHAR AS topic, text FROM benchmark")
def query_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return src.query_lines(rows.select(F.concat_ws("\t", F.col("item_id").cast("string"), "text").alias("value")))


@register("ascii_terms", f"SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}+')) AS word FROM documents")
def ascii_terms(spark, sf_dir):
    """The words of all documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(tx.ascii_words(F.col("text"))).alias("word"))
