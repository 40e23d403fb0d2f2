"""Feedback within and across collections, tuning grids, tiers in stages, and overlapping containers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.catalog._stems import stems_sql
from lexspan.catalog._tables import BOTH, QUERY, RSJ, STATS, THEN, TOK, TOTAL, WORDS, A, B, C, D, engine, reduced, table, term_list, with_
from lexspan.catalog.retrieval import BM25, COVER, RANKED, run_of, tiers, topics
from lexspan.functions.text import STOPWORDS, porter
from lexspan.operators import ranking as rk
from lexspan.operators import search as se
from lexspan.operators import statistics as sl
from lexspan.operators import tuning
from lexspan.plans.engine import StoredEngine
from lexspan.plans.gcl import families, parse
from lexspan.registry import register
from lexspan.sources.postings import Postings

XA, XB, XC = term_list("a", A), term_list("b", B), term_list("c", C)


def bm25_sql(name: str, query: str, k1: float = 0.5, b: float = 0.25, stats: str = "") -> str:
    """A ranking of all topics; ``stats`` is what the collection's tables begin with."""
    return f"""{name} AS (SELECT topic, doc_id, round(sum(weight * {RSJ} * tf / ({k1} * ({1 - b} + {b} * len / avgl) + tf)), 6) AS score
  FROM {stats}tf JOIN {stats}df USING (term) JOIN {query} USING (term) JOIN {stats}dl USING (doc_id), {stats}total WHERE {RSJ} > 0 GROUP BY topic, doc_id)"""


def covers_sql(spot: str, name: str = "best") -> str:
    """The best cover of each topic and document from (topic, doc_id, term, pos, w) of ``spot``."""
    return f"""own AS (SELECT DISTINCT topic, doc_id, term, w FROM {spot}),
ahead AS (SELECT s.topic, s.doc_id, s.pos AS p, o.w, min(CASE WHEN s.term = o.term THEN s.pos END) OVER (PARTITION BY s.topic, s.doc_id, o.term ORDER BY s.pos DESC) AS q FROM {spot} s JOIN own o USING (topic, doc_id)),
nth AS (SELECT topic, doc_id, p, q, row_number() OVER o AS n, sum(w) OVER o AS w FROM ahead WHERE q IS NOT NULL WINDOW o AS (PARTITION BY topic, doc_id, p ORDER BY q ROWS UNBOUNDED PRECEDING)),
scored AS (SELECT topic, doc_id, p, q, n, round(w - CASE n WHEN 1 THEN 0 ELSE n * ln(q - p + 1) END, 9) AS score FROM nth),
{name} AS (SELECT topic, doc_id, score, p, q FROM scored WHERE score > 0 OR n = 1 QUALIFY row_number() OVER (PARTITION BY topic, doc_id ORDER BY score DESC, p, q) = 1)"""


def near_sql(passages: str) -> str:
    """Terms around passages (topic, doc_id, p, q) against chance."""
    return f"""gaps AS (SELECT topic, doc_id, term, min(greatest(CASE WHEN pos < p THEN q - pos WHEN pos <= q THEN q - p + 1 ELSE pos - 1 - p END, 1)) AS gap
  FROM tok JOIN {passages} USING (doc_id) WHERE pos BETWEEN p - 64 AND q + 64 GROUP BY ALL),
chance AS (SELECT topic, term, count(*) AS f, sum(1 - pow(1 - (cf + 1) / (length + vocab), gap)) AS e FROM gaps JOIN df USING (term), total GROUP BY topic, term HAVING count(*) > 1),
near AS (SELECT topic, term, round(f * ln(f / e), 6) AS score FROM chance WHERE f * ln(f / e) > 0)"""


WEIGHTS = "qw AS (SELECT topic, term, ln((length + vocab) / (cf + 1)) AS w FROM (SELECT DISTINCT topic, term FROM {0}) JOIN df USING (term), total)"


@register("qa_prf", with_(STATS, QUERY, BM25, f"run AS ({RANKED.format('b25', 10)})", WEIGHTS.format("topic_terms"), "spot AS (SELECT topic, doc_id, term, pos, w FROM tok JOIN run USING (doc_id) JOIN qw USING (topic, term))", covers_sql("spot"), near_sql("best"), select="SELECT topic, term, score FROM near"))
def qa_prf(spark, sf_dir):
    """Terms around the best cover of each ranked document."""
    e, query = engine(spark, sf_dir), topics(spark, sf_dir)
    run = e.shared(run_of(rk.best_bm25(e.statistics(query), query, 10)))
    places = e.tokens_of(run).join(run.select("topic", "doc_id"), "doc_id").join(rk.term_weights(query, e.vocabulary()), ["topic", "term"])
    return se.window_feedback(e, rk.topic_covers(places), 64)


STOPPED = f"""marked AS (SELECT *, term IN ({', '.join(repr(w) for w in STOPWORDS)}) AS stop FROM topic_terms),
asked AS (SELECT topic, term, weight FROM (SELECT *, bool_and(stop) OVER (PARTITION BY topic) AS whole FROM marked) WHERE NOT stop OR whole)"""


def rsj_sql(run: str, query: str, name: str) -> str:
    """The query with 25 terms more from the documents of a run, by frequency and weight."""
    return f"""seen_{name} AS (SELECT topic, term, count(DISTINCT doc_id) AS f FROM {run} JOIN tf USING (doc_id) GROUP BY ALL),
made_{name} AS (SELECT topic, term, round(f * {RSJ}, 9) AS score FROM seen_{name} JOIN df USING (term), total WHERE f * {RSJ} > 0),
more_{name} AS (SELECT topic, term, 0.2 * score / best AS weight FROM (SELECT *, max(score) OVER (PARTITION BY topic) AS best, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM made_{name}) WHERE rank <= 25),
{name} AS (SELECT topic, term, sum(weight) AS weight FROM (SELECT * FROM {query} UNION ALL SELECT * FROM more_{name}) GROUP BY ALL)"""


@register("pipeline_two_pass", with_(STATS, QUERY, STOPPED, bm25_sql("one", "asked"), f"run AS ({RANKED.format('one', 10)})", rsj_sql("run", "asked", "wider"), bm25_sql("two", "wider"), select=RANKED.format("two", 20)))
def pipeline_two_pass(spark, sf_dir):
    """Stop words go, the first ranking tells 25 terms, weighted by their scores, the second ranks by all."""
    return se.Pipeline("stop bm25:depth=10 rsj:expansions=25,scaled=1 bm25:depth=20").run(engine(spark, sf_dir), table(spark, sf_dir, "benchmark"))


# two collections: the documents, and the turns of conversations

TURNS = """turn_docs AS (SELECT conv_id * 1000000 + turn AS doc_id, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
b_tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM turn_docs),
b_tf AS (SELECT doc_id, term, count(*) AS tf FROM b_tok GROUP BY ALL), b_df AS (SELECT term, count(*) AS df FROM b_tf GROUP BY ALL), b_dl AS (SELECT doc_id, count(*) AS len FROM b_tok GROUP BY ALL),
b_total AS (SELECT count(*) AS items, sum(len) / count(*) AS avgl FROM b_dl)"""
#: BM25 parameters of the cross-collection run.
K1, B_ = 1.18281, 0.447428


def turns(spark, sf_dir, stem: bool = False) -> StoredEngine:
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    docs = rows.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("doc_id"), "text")
    return StoredEngine(Postings.stored(spark, f"{sf_dir}/conversations.parquet", docs, "turns"), docs, stem=stem)


@register("cross_feedback", with_(STATS, QUERY, STOPPED, TURNS, bm25_sql("plain_run", "asked", K1, B_, "b_"), WEIGHTS.format("asked"), "spot AS (SELECT topic, doc_id, term, pos, w FROM tok JOIN qw USING (term))", covers_sql("spot"),
    "passages AS (SELECT topic, doc_id, p, q FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS rank FROM best) WHERE rank <= 32)", near_sql("passages"),
    "new_query AS (SELECT topic, term, score AS weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM near) WHERE rank <= 16)", bm25_sql("fed_run", "new_query", K1, B_, "b_"),
    f"runs AS ({RANKED.format('plain_run', 50)} UNION ALL {RANKED.format('fed_run', 50)})", select="SELECT topic, doc_id, round(sum(1 / (60 + rank)), 6) AS score FROM runs GROUP BY topic, doc_id"))
def cross_feedback(spark, sf_dir):
    """The documents tell what stands near the best covers of each topic; this ranks the turns, and is fused with the plain ranking of turns."""
    first, second, query = engine(spark, sf_dir), turns(spark, sf_dir), se.stopped(topics(spark, sf_dir))
    plain = rk.best_bm25(second.statistics(query), query, 50, K1, B_)
    fed = se.cross_feedback(first, second, query, 16, 32, 64, k1=K1, b=B_, most=50)
    return rk.reciprocal_rank_fusion(plain.unionByName(fed)).withColumn("score", F.round("score", 6))


#: The first ranking of the fusion, and its parameters.
FIRST = "stem bm25:k1=1.18281,b=0.447428 rsj:depth=17,expansions=25,gamma=0.145504 stem bm25:depth=20,k1=1.02941,b=0.481409"
#: The turns with stems beside their words.
STEM_TURNS = """s_tf AS (SELECT term, doc_id, tf FROM b_tf UNION ALL SELECT stem, doc_id, sum(tf)::BIGINT FROM b_tf JOIN fam USING (term) WHERE stem <> term GROUP BY ALL),
s_df AS (SELECT term, count(*) AS df FROM s_tf GROUP BY ALL), s_dl AS (SELECT * FROM b_dl), s_total AS (SELECT * FROM b_total)"""


@register("feedback_fusion", with_(STATS, QUERY, TURNS, WEIGHTS.format("topic_terms"), "spot AS (SELECT topic, doc_id, term, pos, w FROM tok JOIN qw USING (term))", covers_sql("spot"),
    "passages AS (SELECT topic, doc_id, p, q FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS rank FROM best) WHERE rank <= 32)", near_sql("passages"),
    "fresh AS (SELECT topic, term, score AS weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM near) WHERE rank <= 16)",
    stems_sql("SELECT term FROM b_df UNION SELECT term FROM topic_terms UNION SELECT term FROM fresh"), STEM_TURNS,
    "asked AS (SELECT topic, stem AS term, sum(weight) AS weight FROM topic_terms JOIN fam USING (term) GROUP BY ALL)", bm25_sql("one", "asked", K1, B_, "s_"), f"run AS ({RANKED.format('one', 17)})",
    "seen AS (SELECT topic, term, count(DISTINCT doc_id) AS f FROM run JOIN b_tf USING (doc_id) GROUP BY ALL)", f"made AS (SELECT topic, term, round(f * {RSJ}, 9) AS score FROM seen JOIN b_df USING (term), b_total WHERE f * {RSJ} > 0)",
    "more AS (SELECT topic, term, 0.145504::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM made) WHERE rank <= 25)",
    "wider AS (SELECT topic, term, sum(weight) AS weight FROM (SELECT * FROM asked UNION ALL SELECT topic, stem, weight FROM more JOIN fam USING (term)) GROUP BY ALL)", bm25_sql("plain_run", "wider", 1.02941, 0.481409, "s_"),
    "new_query AS (SELECT topic, stem AS term, sum(weight) AS weight FROM fresh JOIN fam USING (term) GROUP BY ALL)", bm25_sql("fed_run", "new_query", K1, B_, "s_"),
    f"runs AS ({RANKED.format('plain_run', 20)} UNION ALL {RANKED.format('fed_run', 20)})", select="SELECT topic, doc_id, round(sum(1 / (60 + rank)), 6) AS score FROM runs GROUP BY topic, doc_id"))
def feedback_fusion(spark, sf_dir):
    """By stems: the words around the best covers of each topic in the documents rank the turns, and are fused with the two passes of ``FIRST`` over the turns."""
    first, second = engine(spark, sf_dir), turns(spark, sf_dir, stem=True)
    plain = se.Pipeline(FIRST).run(second, table(spark, sf_dir, "benchmark"))
    fed = se.cross_feedback(first, second, topics(spark, sf_dir), 16, 32, 64, stem=True, k1=K1, b=B_, most=20)
    return rk.reciprocal_rank_fusion(run_of(plain).unionByName(run_of(fed))).withColumn("score", F.round("score", 6))


# tuning

GRID = [{"k1": k1, "b": b} for k1 in (0.5, 0.9, 1.2) for b in (0.25, 0.75)]
GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {g['k1']}, {g['b']})" for n, g in enumerate(GRID)) + ") g(trial, k1, b))"


@register("bm25_grid", with_(STATS, QUERY, GRID_SQL, f"s AS (SELECT trial, topic, doc_id, round(sum(weight * {RSJ} * tf / (k1 * (1 - b + b * len / avgl) + tf)), 6) AS score FROM tf JOIN df USING (term) JOIN topic_terms USING (term) JOIN dl USING (doc_id), total, grid WHERE {RSJ} > 0 GROUP BY ALL)",
    "r AS (SELECT trial, topic, doc_id, row_number() OVER (PARTITION BY trial, topic ORDER BY score DESC, doc_id) AS rank FROM s)",
    "v AS (SELECT trial, topic, coalesce(1 / min(CASE WHEN quality = 1 THEN rank END), 0) AS value FROM r LEFT JOIN labels USING (doc_id) WHERE rank <= 10 GROUP BY ALL)",
    select="SELECT trial::INT AS trial, k1::DOUBLE AS k1, b::DOUBLE AS b, count(*) AS topics, round(avg(value), 6) AS mrr FROM v JOIN grid USING (trial) GROUP BY ALL"))
def bm25_grid(spark, sf_dir):
    """All settings of k1 and b in one job: the mean reciprocal rank of the first good document of each topic."""
    e, query = engine(spark, sf_dir), topics(spark, sf_dir)
    runs = tuning.bm25_trials(e.statistics(query), query, GRID, 10)
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    first = F.min(F.when(F.col("good"), F.col("rank")))
    value = runs.join(good, "doc_id", "left").groupBy("trial", "k1", "b", "topic").agg(F.coalesce(1 / first, F.lit(0.0)).alias("value"))
    return value.groupBy("trial", "k1", "b").agg(F.count("*").alias("topics"), F.round(F.avg("value"), 6).alias("mrr"))


# tiers

SUBSETS = {1: "a", 2: "b", 4: "c", 3: "ab", 5: "ac", 6: "bc", 7: "abc"}


def tiers_sql() -> str:
    """The first tier that finds a document, tiers made of all subsets of the three terms by weight."""
    lists = [
        "k0 AS (SELECT doc_id, pos AS p, pos AS q FROM tok JOIN w USING (term) WHERE k = 0)", "k1 AS (SELECT doc_id, pos AS p, pos AS q FROM tok JOIN w USING (term) WHERE k = 1)",
        "k2 AS (SELECT doc_id, pos AS p, pos AS q FROM tok JOIN w USING (term) WHERE k = 2)",
        *(f"m{1 << i} AS ({reduced(THEN.format(f'k{i}', f'k{i}'))})" for i in range(3)),
        f"m3 AS ({reduced(BOTH.format('k0', 'k1'))})", f"m5 AS ({reduced(BOTH.format('k0', 'k2'))})", f"m6 AS ({reduced(BOTH.format('k1', 'k2'))})", f"m7 AS ({reduced(BOTH.format('m3', 'k2'))})",
    ]
    union = " UNION ALL ".join(f"SELECT {m}::BIGINT AS m, doc_id, p, q FROM m{m}" for m in (1, 2, 3, 4, 5, 6, 7))
    return with_(
        STATS, f"w AS (SELECT term, ln((length + vocab) / (cf + 1)) AS w, row_number() OVER (ORDER BY w DESC, term) - 1 AS k FROM df, total WHERE term IN ('{A}', '{B}', '{C}'))",
        "subset AS (SELECT m, sum(w) AS w, list(term ORDER BY k) AS c FROM range(1, 8) r(m), w WHERE (m >> k) & 1 = 1 GROUP BY m)",
        "step AS (SELECT row_number() OVER (ORDER BY w DESC, c) AS n, w, m FROM subset)",
        "walk AS (SELECT n, m, 0::BIGINT AS tier, w AS last FROM step WHERE n = 1 UNION ALL SELECT s.n, s.m, CASE WHEN last - s.w >= 1 THEN tier + 1 ELSE tier END, CASE WHEN last - s.w >= 1 THEN s.w ELSE last END FROM walk JOIN step s ON s.n = walk.n + 1)",
        *lists, f"every AS (SELECT tier, doc_id, p, min(q) AS q FROM ({union}) JOIN walk USING (m) GROUP BY ALL)",
        "least_ AS (SELECT tier, doc_id, p, q FROM (SELECT *, min(q) OVER (PARTITION BY tier, doc_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM every) WHERE later IS NULL OR q < later)",
        "u AS (SELECT tier, doc_id, sum(1 / (42 + q - p)) AS score FROM least_ GROUP BY ALL)", "f AS (SELECT doc_id, min(tier) AS tier, arg_min(score, tier) AS score FROM u GROUP BY doc_id)",
        select="SELECT doc_id, tier, round(score + ((SELECT max(tier) FROM walk) - tier) * 1000000, 6) AS score FROM f ORDER BY 3 DESC, 1 LIMIT 50",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


@register("tiered", tiers_sql())
def tiered(spark, sf_dir):
    """Tiers of the sample terms by their weights, the next one asked only for places that are still open."""
    return se.tiered(engine(spark, sf_dir), tiers(spark, sf_dir), 50)


# containers

BOXES = f"""ends_ AS ({reduced(THEN.format('a', 'c'))}),
box AS (SELECT doc_id, p, q FROM ends_ UNION SELECT doc_id, 0, max(pos) FROM tok GROUP BY doc_id UNION SELECT doc_id, s, s + 39 FROM (SELECT doc_id, unnest(range(0, max(pos) + 1, 20)) AS s FROM tok GROUP BY doc_id))"""


def boxes(e: StoredEngine) -> DataFrame:
    """Spans between two terms, whole documents, and windows of 40 words every 20: they overlap and are nested."""
    items = e.items()
    windows = items.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q"), F.lit(20).cast("long"))).alias("p")).withColumn("q", F.col("p") + 39)
    return e.gcl(f"(... {A} {C})").select("doc_id", "p", "q").unionByName(items.select("doc_id", "p", "q")).unionByName(windows).distinct()


@register("container_density", with_(TOK, XA, XB, XC, COVER, BOXES, select="SELECT b.doc_id, b.p AS container_p, b.q AS container_q, round(sum(1 / (42 + c.q - c.p)), 6) AS score, arg_min(c.p, (c.q - c.p) * 1000000 + c.p) AS p, arg_min(c.q, (c.q - c.p) * 1000000 + c.p) AS q FROM box b JOIN cover c ON c.doc_id = b.doc_id AND c.p >= b.p AND c.q <= b.q GROUP BY ALL"))
def container_density(spark, sf_dir):
    """Every container that holds covers, with their density and the best of them."""
    e = engine(spark, sf_dir)
    return rk.cover_density(e.gcl(f"(^ {A} {B})"), containers=boxes(e)).withColumn("score", F.round("score", 6))


@register("container_attach", with_(TOK, XA, XB, XC, COVER, BOXES, select="SELECT c.doc_id, c.p, c.q, arg_min(b.p, b.q * 1000000 - b.p) AS container_p, min(b.q) AS container_q FROM cover c LEFT JOIN box b ON b.doc_id = c.doc_id AND b.q >= c.q GROUP BY ALL"))
def container_attach(spark, sf_dir):
    """Every cover with the container that ends first at or behind its end."""
    e = engine(spark, sf_dir)
    return rk.attached(e.gcl(f"(^ {A} {B})").select("doc_id", "p", "q"), boxes(e))


# statistics by recipe

SPAN_STATS = f"""ends_ AS ({reduced(THEN.format('a', 'c'))}), stf AS (SELECT e.doc_id, e.p, e.q, term, count(*) AS tf FROM ends_ e JOIN tok t ON t.doc_id = e.doc_id AND t.pos BETWEEN e.p AND e.q JOIN (SELECT DISTINCT term FROM topic_terms) USING (term) GROUP BY ALL),
sdf AS (SELECT term, count(*) AS df FROM stf GROUP BY term), stotal AS (SELECT count(*) AS items, avg(q - p + 1) AS avgl FROM ends_),
sb AS (SELECT topic, doc_id, p, q, round(sum(weight * {RSJ} * tf / (0.5 * (0.75 + 0.25 * (q - p + 1) / avgl) + tf)), 6) AS score FROM stf JOIN sdf USING (term) JOIN topic_terms USING (term), stotal WHERE {RSJ} > 0 GROUP BY ALL)"""


@register("stats_selection", with_(STATS, QUERY, BM25, XA, XC, SPAN_STATS, select="""SELECT 'df' AS recipe, topic, doc_id, -1::BIGINT AS p, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS rank FROM b25) WHERE rank <= 5
  UNION ALL SELECT 'idf', topic, doc_id, p, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id, p, q) AS rank FROM sb) WHERE rank <= 5"""))
def stats_selection(spark, sf_dir):
    """The same ranker over two statistics: stored counts of documents, and counts inside spans between two terms."""
    e, query = engine(spark, sf_dir), topics(spark, sf_dir)
    whole = rk.best_bm25(sl.select(e, {"statistics": "df"}, query), query, 5).select(F.lit("df").alias("recipe"), "topic", "doc_id", F.lit(-1).cast("long").alias("p"), "score")
    parts = rk.best_bm25(sl.select(e, {"container": f"(... {A} {C})"}, query), query, 5)
    return whole.unionByName(parts.select(F.lit("idf").alias("recipe"), "topic", "doc_id.doc_id", "doc_id.p", "score"))


# families and summaries


def family(stem: str) -> list[str]:
    """Words other than the stem that the stemmer takes to it, by one or two endings."""
    ends = ["", "s", "e", "es", "ed", "eds", "ing", "ings", "ion", "ions", "ive", "ate", "able", "al", "ic", "ness", "ment"]
    return sorted({w for x in ends for y in ends for w in [stem + x + y] if w != stem and porter(w) == stem})


@register("family_search", with_(TOK, XA, f"x AS (SELECT doc_id, pos AS p, pos AS q FROM tok WHERE term IN ({', '.join(repr(w) for w in family('thing'))}))", select=reduced(BOTH.format("x", "a"))))
def family_search(spark, sf_dir):
    """A word's family beside a term."""
    return engine(spark, sf_dir, stem=True).gcl(families(parse(f"(^ thing* {A})"))).select("doc_id", "p", "q")


@register("cover_summary", with_(TOK, XA, XB, COVER, WORDS, "top_ AS (SELECT doc_id, round(sum(1 / (42 + q - p)), 6) AS score FROM cover GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 10)",
    "tight AS (SELECT doc_id, p, q FROM cover JOIN top_ USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY q - p, p) <= 3)",
    "win AS (SELECT doc_id, p, q, greatest(0, least((p + q + 1 - greatest(75, q - p + 1)) // 2, len(t) - greatest(75, q - p + 1))) AS a, len(t) AS n FROM tight JOIN said USING (doc_id))",
    "ab_ AS (SELECT doc_id, p, q, a, least(n, a + greatest(75, q - p + 1)) AS b FROM win)",
    "isle AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p, q) AS span FROM (SELECT *, (a > coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY p, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INT AS fresh FROM ab_))",
    "span_ AS (SELECT doc_id, span, min(a) AS a, max(b) AS b FROM isle GROUP BY ALL)",
    "open_ AS (SELECT *, 150 - coalesce(sum(b - a) OVER (PARTITION BY doc_id ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM span_)",
    select="SELECT doc_id, score, string_agg(concat(array_to_string(t[a + 1 : least(b, a + room)], ' '), CASE WHEN b - a > room THEN ' ...' ELSE '' END), ' . . . ' ORDER BY span) AS summary FROM open_ JOIN said USING (doc_id) JOIN top_ USING (doc_id) WHERE room > 0 GROUP BY doc_id, score"))
def cover_summary(spark, sf_dir):
    """The best documents with the words around their tightest covers."""
    return se.summaries(engine(spark, sf_dir), f"(^ {A} {B})", 10)
