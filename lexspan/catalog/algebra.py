"""Interval algebra and scans over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.catalog._tables import BOTH, QUERY, THEN, TOK, WORDS, A, B, C, D, engine, reduced, spans, table, term_list, with_
from lexspan.operators import intervals as iv
from lexspan.plans.gcl import Infix, leaves, parse
from lexspan.registry import register

XA, XB, XC, XD = term_list("a", A), term_list("b", B), term_list("c", C), term_list("d", D)
WHOLE = "w AS (SELECT doc_id, 0::BIGINT AS p, max(pos) AS q FROM tok GROUP BY ALL)"


def gcl(name: str, expr: str, sql: str) -> None:
    register(name, sql)(lambda spark, sf_dir: spans(engine(spark, sf_dir).gcl(expr)))


gcl("term_scan", A, with_(TOK, select=f"SELECT doc_id, pos AS p, pos AS q FROM tok WHERE term = '{A}'"))
gcl("gcl_all_of", f"(^ {A} {B})", with_(TOK, XA, XB, select=reduced(BOTH.format("a", "b"))))
gcl("gcl_one_of", f"(+ {A} {B} {C})", with_(TOK, select=f"SELECT doc_id, pos AS p, pos AS q FROM tok WHERE term IN ('{A}', '{B}', '{C}')"))
gcl("gcl_followed_by", f"(... {A} {B})", with_(TOK, XA, XB, select=reduced(THEN.format("a", "b"))))
AB = f"ab AS ({reduced(THEN.format('a', 'b'))})"
for _name, _op, _sql in (
    ("gcl_contained_in", f"(<< {C} (... {A} {B}))", "SELECT doc_id, p, q FROM c WHERE EXISTS (SELECT 1 FROM ab y WHERE y.doc_id = c.doc_id AND y.p <= c.p AND c.q <= y.q)"),
    ("gcl_not_contained_in", f"(!< {C} (... {A} {B}))", "SELECT doc_id, p, q FROM c WHERE NOT EXISTS (SELECT 1 FROM ab y WHERE y.doc_id = c.doc_id AND y.p <= c.p AND c.q <= y.q)"),
    ("gcl_containing", f"(>> (... {A} {B}) {C})", "SELECT doc_id, p, q FROM ab x WHERE EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND x.p <= c.p AND c.q <= x.q)"),
    ("gcl_not_containing", f"(!> (... {A} {B}) {C})", "SELECT doc_id, p, q FROM ab x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND x.p <= c.p AND c.q <= x.q)"),
):
    gcl(_name, _op, with_(TOK, XA, XB, XC, AB, select=_sql))
gcl("gcl_window", f"(>> (# 5) (... {A} {B}))", with_(TOK, XA, XB, AB, select="SELECT DISTINCT doc_id, unnest(range(q - 4, p + 1)) AS p, p + 4 AS q FROM (SELECT * FROM ab WHERE q - p + 1 <= 5)").replace("SELECT DISTINCT doc_id, unnest(range(q - 4, p + 1)) AS p, p + 4 AS q FROM", "SELECT DISTINCT doc_id, s AS p, s + 4 AS q FROM (SELECT doc_id, unnest(range(q - 4, p + 1)) AS s FROM") + ")")
gcl("gcl_window_filter", f"(<< (^ {A} {B}) (# 10))", with_(TOK, XA, XB, f"ab AS ({reduced(BOTH.format('a', 'b'))})", select="SELECT doc_id, p, q FROM ab WHERE q - p + 1 <= 10"))
gcl("gcl_window_both", f"(^ (# 8) (... {A} {B}))", with_(TOK, XA, XB, AB, f"win AS ({'SELECT DISTINCT doc_id, s AS p, s + 7 AS q FROM (SELECT doc_id, unnest(range(q - 7, p + 1)) AS s FROM ab WHERE q - p + 1 <= 8)'} UNION ALL SELECT doc_id, p, q FROM ab WHERE q - p + 1 >= 8)", select=reduced("SELECT * FROM win")))
PAIR = f"ph AS (SELECT doc_id, pos AS p, pos + 1 AS q FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM tok) WHERE term = '{D}' AND after = 'the')"
gcl("gcl_phrase", f'"{D} the"', with_(TOK, PAIR, select="SELECT doc_id, p, q FROM ph"))
gcl("gcl_nary", f"(... {A} {B} {C})", with_(TOK, XA, XB, XC, AB, select=reduced(THEN.format("ab", "c"))))
gcl("gcl_materialize", f"(^ (% (... {A} {B})) {C})", with_(TOK, XA, XB, XC, AB, select=reduced(BOTH.format("ab", "c"))))
gcl("gcl_shared", f"(+ (>> (% (... {A} {B})) {C}) (^ (... {A} {B}) {D}))", with_(TOK, XA, XB, XC, XD, AB, "l AS (SELECT doc_id, p, q FROM ab x WHERE EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND x.p <= c.p AND c.q <= x.q))", f"r AS ({reduced(BOTH.format('ab', 'd'))})", select=reduced("SELECT doc_id, p, q FROM l UNION ALL SELECT doc_id, p, q FROM r")))
gcl("gcl_phrase_in_facet", f'(^ (+ {A} "{D} the") {B})', with_(TOK, XA, XB, PAIR, f"f AS ({reduced('SELECT doc_id, p, q FROM a UNION ALL SELECT doc_id, p, q FROM ph')})", select=reduced(BOTH.format("f", "b"))))


@register("gcl_infix", with_(TOK, XA, XB, XC, f"ab AS ({reduced(BOTH.format('a', 'b'))})", select="SELECT doc_id, p, q FROM ab x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND x.p <= c.p AND c.q <= x.q)"))
def gcl_infix(spark, sf_dir):
    reader = Infix()
    reader.read(f'pair = "{A}" and "{B}"')
    return spans(engine(spark, sf_dir).gcl(reader.read(f'pair not containing "{C}"')))


# conversations as a graph: each turn of a conversation holds the address of the turn before

CONV = "turns AS (SELECT conv_id AS doc_id, turn AS p, turn AS q, (turn - 1)::DOUBLE AS v FROM conversations WHERE turn > 0)"


@register("gcl_link", "SELECT DISTINCT conv_id AS doc_id, turn - 1 AS p, turn - 1 AS q FROM conversations WHERE turn > 0 AND role = 'assistant'")
def gcl_link(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("turn > 0 and role = 'assistant'")
    return spans(iv.link(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("p"), F.col("turn").alias("q"), (F.col("turn") - 1).cast("double").alias("v"))))


@register("gcl_merge", with_(TOK, select=f"SELECT doc_id, pos AS p, pos AS q, CASE term WHEN '{A}' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS v FROM tok WHERE term IN ('{A}', '{B}')"))
def gcl_merge(spark, sf_dir):
    e = engine(spark, sf_dir)
    return iv.merge(e.gcl(A).withColumn("v", F.lit(1.0)), e.gcl(B).withColumn("v", F.lit(2.0)))


@register("gc_reduce", with_(TOK, XA, XB, select=reduced(BOTH.format("a", "b"))))
def gc_reduce(spark, sf_dir):
    e = engine(spark, sf_dir)
    a, b = e.gcl(A), e.gcl(B).select("doc_id", F.col("p").alias("p2"), F.col("q").alias("q2"))
    pairs = a.join(b, "doc_id").select("doc_id", F.least("p", "p2").alias("p"), F.greatest("q", "q2").alias("q"), "v")
    return spans(iv.gc_reduce(pairs))


# scans

@register("term_df", with_(TOK, select="SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM tok GROUP BY term"))
def term_df(spark, sf_dir):
    return engine(spark, sf_dir).vocabulary().select("term", F.col("cf").alias("n"), "df")


@register("vocab_size", with_(TOK, select="SELECT count(DISTINCT term) AS vocab FROM tok"))
def vocab_size(spark, sf_dir):
    return engine(spark, sf_dir).vocabulary().agg(F.count("term").alias("vocab"))


@register("token_total", with_(TOK, select="SELECT count(*) AS n_tokens, count(DISTINCT doc_id) AS items FROM tok"))
def token_total(spark, sf_dir):
    return engine(spark, sf_dir).items().agg(F.sum(F.col("q") + 1).alias("n_tokens"), F.count("*").alias("items"))


@register("item_spans", with_(TOK, select="SELECT doc_id, 0::BIGINT AS p, max(pos) AS q FROM tok GROUP BY doc_id"))
def item_spans(spark, sf_dir):
    return spans(engine(spark, sf_dir).items())


@register("value_histogram", "SELECT v, count(*) AS n FROM (SELECT l_quantity AS v FROM lineitem UNION ALL SELECT l_discount FROM lineitem) GROUP BY v")
def value_histogram(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.explode(F.array("l_quantity", "l_discount")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


@register("translate_span", with_(TOK, XA, XB, AB, WORDS, select="SELECT doc_id, p, q, array_to_string(t[p + 1 : q + 1], ' ') AS said FROM ab JOIN said USING (doc_id)"))
def translate_span(spark, sf_dir):
    """The words of every span."""
    e = engine(spark, sf_dir)
    return e.translate(spans(e.gcl(f"(... {A} {B})")))


@register("concordance", with_(TOK, XA, XB, AB, WORDS, select="""SELECT doc_id, p, q, array_to_string(t[greatest(p - 5, 0) + 1 : p], ' ') AS before, array_to_string(t[p + 1 : q + 1], ' ') AS said,
  array_to_string(t[q + 2 : q + 6], ' ') AS after FROM ab JOIN said USING (doc_id)"""))
def concordance(spark, sf_dir):
    """Every span with the five words before and after it."""
    e = engine(spark, sf_dir)
    return e.around(spans(e.gcl(f"(... {A} {B})")), 5)


@register("count_matches", with_(TOK, select=f"SELECT count(*) AS n FROM (SELECT doc_id FROM tok WHERE term = '{A}' INTERSECT SELECT doc_id FROM tok WHERE term = '{B}')"))
def count_matches(spark, sf_dir):
    return engine(spark, sf_dir).gcl(f"(>> :item (^ {A} {B}))").agg(F.count("*").alias("n"))


@register("posting_budget", with_(TOK, f"own AS (SELECT term, count(*) AS n, 24 * count(*) AS bytes FROM tok WHERE term IN ('{A}', '{B}', '{C}', '{D}', 'the') GROUP BY term)", select="SELECT term, n, bytes, sum(bytes) OVER ()::BIGINT AS total, sum(bytes) OVER () <= 2000000 AS admitted FROM own ORDER BY bytes DESC, term LIMIT 4"))
def posting_budget(spark, sf_dir):
    terms = leaves(parse(f'(^ {A} (+ {B} {C} "{D} the"))'))
    counts = engine(spark, sf_dir).vocabulary().where(F.col("term").isin(*terms)).select("term", F.col("cf").alias("n"), (F.col("cf") * 24).alias("bytes"))
    total = counts.agg(F.sum("bytes").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("admitted", F.col("total") <= 2_000_000).orderBy(F.desc("bytes"), "term").limit(4)


@register("container_dump", with_(TOK, WORDS, select="SELECT doc_id, array_to_string(t, ' ') AS line FROM said WHERE len(t) > 0"))
def container_dump(spark, sf_dir):
    """Every container as one line of text."""
    e = engine(spark, sf_dir)
    return e.translate(spans(e.gcl(":item"))).select("doc_id", F.col("said").alias("line"))


@register("tf_spans", with_(TOK, WHOLE, select=f"SELECT w.doc_id, w.p, w.q, count(*)::DOUBLE AS v FROM tok JOIN w USING (doc_id) WHERE term = '{A}' GROUP BY ALL"))
def tf_spans(spark, sf_dir):
    """Term frequencies, annotated at the first place of a content interval, with that interval."""
    e = engine(spark, sf_dir)
    tf = e.gcl(A).groupBy("doc_id").agg(F.count("*").cast("double").alias("v")).withColumn("p", F.lit(0).cast("long"))
    return iv.with_content(tf, e.items())


@register("single_sources", with_(TOK, WHOLE, select="SELECT doc_id, p, q, (q + 1)::DOUBLE AS v FROM w ORDER BY q DESC, doc_id LIMIT 1"))
def single_sources(spark, sf_dir):
    """A list of one interval, the longest document with its length, and the empty list merged into it."""
    longest = engine(spark, sf_dir).items().orderBy(F.desc("q"), "doc_id").limit(1).withColumn("v", (F.col("q") + 1).cast("double"))
    return iv.merge(longest, iv.single(spark))


@register("query_weights", with_(QUERY, select="SELECT topic, term, weight FROM topic_terms"))
def query_weights(spark, sf_dir):
    from lexspan.operators.ranking import query_terms

    return query_terms(table(spark, sf_dir, "benchmark"))
