"""Search operators over an engine: text and interval queries, tiers, summaries, feedback, pipelines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspan.functions import text as tx
from lexspan.functions.text import STOPWORDS
from lexspan.operators import ranking as rk
from lexspan.plans.engine import Engine
from lexspan.plans.gcl import Expr, words_of

#: Tiers are this far apart in the scores of a tiered search.
TIER_STEP = 1_000_000


def search_gcl(engine: Engine, expr: Expr | str, depth: int) -> DataFrame:
    """The documents with the densest covers of an expression."""
    return rk.top(rk.cover_density(engine.gcl(expr)), depth)


def search_text(engine: Engine, text: str, depth: int) -> DataFrame:
    """Documents for a text: by covers of its terms if it has two or more, else by density."""
    terms = list(dict.fromkeys(words_of(text)))
    if len(terms) < 2:
        return search_gcl(engine, terms[0], depth).select("doc_id", "score", "p", "q")
    total = engine.totals()
    found = rk.icover(engine.places(terms), terms, total["length"], total["vocab"], engine.counts(terms), depth)
    return found.select("doc_id", F.round("score", 6).alias("score"), "p", "q")


def cover_search(engine: Engine, expr: Expr | str, depth: int, exclude: DataFrame) -> DataFrame:
    """As ``search_gcl``, without the excluded documents."""
    return rk.top(rk.cover_density(engine.gcl(expr)).join(exclude.select("doc_id").distinct(), "doc_id", "left_anti"), depth)


def tiered(engine: Engine, tiers: list[Expr | str], depth: int) -> DataFrame:
    """(doc_id, tier, score): each document in the first tier that finds it, the tiers in order.

    A stage for each tier: it looks for as many documents as are still open, without those found before, and
    when ``depth`` are found the later tiers are never evaluated. A stage gives the driver at most ``depth`` rows.
    """
    spark, found = engine.spark, []
    for n, expr in enumerate(tiers):
        density = rk.cover_density(engine.gcl(expr)).select("doc_id", "score")
        if found:
            known = spark.createDataFrame([(d,) for d, _, _ in found], "doc_id long")
            density = density.join(F.broadcast(known), "doc_id", "left_anti")
        # a score is rounded with the step of its tier, as ties are told by the rounded number
        raised = density.withColumn("score", F.col("score") + float((len(tiers) - 1 - n) * TIER_STEP))
        found += [(r.doc_id, n, r.score) for r in rk.top(raised, depth - len(found)).collect()]
        if len(found) >= depth:
            break
    return spark.createDataFrame(found, "doc_id long, tier long, score double")


def summaries(engine: Engine, expr: Expr | str, depth: int, keep: int = 3, window: int = 75, most: int = 150) -> DataFrame:
    """The best documents with the words around their tightest covers.

    A window of ``window`` words is centred on each cover and moved inside the document; windows that touch are
    one; ``most`` words are shown.
    """
    covers = engine.gcl(expr)
    best = rk.top(rk.cover_density(covers), depth).select("doc_id", "score")
    words = engine.docs.join(best, "doc_id").select("doc_id", "score", tx.words(F.col("text")).alias("words"))
    order = Window.partitionBy("doc_id").orderBy(F.col("q") - F.col("p"), "p")
    tight = covers.join(best.select("doc_id"), "doc_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    size = F.greatest(F.lit(window), F.col("q") - F.col("p") + 1)
    length = F.size("words")
    start = F.greatest(F.lit(0), F.least(F.floor((F.col("p") + F.col("q") + 1 - size) / 2), length - size))
    own = tight.join(words.select("doc_id", "words"), "doc_id").select("doc_id", "p", "q", start.alias("a"), F.least(length.cast("long"), start + size).alias("b"))
    by = Window.partitionBy("doc_id")
    seen = by.orderBy("p", "q").rowsBetween(Window.unboundedPreceding, -1)
    fresh = own.withColumn("fresh", (F.col("a") > F.coalesce(F.max("b").over(seen), F.lit(-1))).cast("int"))
    spans = fresh.withColumn("span", F.sum("fresh").over(by.orderBy("p", "q"))).groupBy("doc_id", "span").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    told = by.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    shown = spans.withColumn("left", F.lit(most) - F.coalesce(F.sum(F.col("b") - F.col("a")).over(told), F.lit(0))).where("left > 0")
    said = F.array_join(F.slice("words", (F.col("a") + 1).cast("int"), F.least(F.col("b") - F.col("a"), F.col("left")).cast("int")), " ")
    parts = shown.join(words, "doc_id").select("doc_id", "score", "span", F.concat(said, F.when(F.col("b") - F.col("a") > F.col("left"), " ...").otherwise("")).alias("said"))
    listed = parts.groupBy("doc_id", "score").agg(F.array_sort(F.collect_list(F.struct("span", "said"))).alias("parts"))
    return listed.select("doc_id", "score", F.array_join("parts.said", " . . . ").alias("summary"))


def highlighted(engine: Engine, expr: Expr | str, depth: int, around: int = 10) -> DataFrame:
    """The best documents with the best cover marked in the words around it."""
    best = search_gcl(engine, expr, depth)
    words = engine.docs.select("doc_id", tx.words(F.col("text")).alias("words"))
    part = lambda start, size: F.array_join(F.slice("words", (start + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int")), " ")
    start = F.greatest(F.col("p") - around, F.lit(0))
    said = F.concat(part(start, F.col("p") - start), F.lit(" <cover>"), part(F.col("p"), F.col("q") - F.col("p") + 1), F.lit("</cover> "), part(F.col("q") + 1, F.lit(around)))
    return best.join(words, "doc_id").select("doc_id", "score", said.alias("snippet"))


def answer_terms(engine: Engine, query: list[str], depth: int, passages: int = 32, window: int = 64) -> DataFrame:
    """Words that stand near the query's best passages: the weight of a word falls with its distance
    from a passage, sums over the passages, and rare words weigh more."""
    total = engine.totals()
    size = total["length"] + total["vocab"]
    best = rk.icover(engine.places(query), query, total["length"], total["vocab"], engine.counts(query), passages).select("doc_id", F.col("p").alias("from"), F.col("q").alias("to"))
    near = engine.tokens_of(best).join(best, "doc_id").where((F.col("pos") >= F.col("from") - window) & (F.col("pos") <= F.col("to") + window))
    distance = F.greatest(F.col("from") - F.col("pos"), F.col("pos") - F.col("to"), F.lit(0))
    gain = F.greatest(F.log(size / (F.col("cf") * (distance + 1))), F.lit(0.0))
    scored = near.join(engine.vocabulary().select("term", "cf"), "term").groupBy("term").agg(F.sum(gain).alias("score"), F.countDistinct("doc_id").alias("docs"))
    return scored.where(~F.col("term").isin(*query)).withColumn("score", F.round(F.pow("score", F.lit(3.0)), 3)).orderBy(F.desc("score"), "term").limit(depth)


def window_feedback(engine: Engine, passages: DataFrame, window: int) -> DataFrame:
    """(topic, term, score): terms that stand near more of a topic's passages than their frequency lets expect.
    Near is up to ``window`` places before or after (p, q); the exponent of a term is its least gap, 1 at least."""
    near = engine.tokens_of(passages).join(passages, "doc_id").where(F.col("pos").between(F.col("p") - window, F.col("q") + window))
    gap = F.when(F.col("pos") < F.col("p"), F.col("q") - F.col("pos")).when(F.col("pos") <= F.col("q"), F.col("q") - F.col("p") + 1).otherwise(F.col("pos") - 1 - F.col("p"))
    gaps = near.groupBy("topic", "doc_id", "term").agg(F.min(F.greatest(gap, F.lit(1))).alias("gap"))
    chance = (F.col("cf") + 1) / (F.col("length") + F.col("vocab"))
    rows = gaps.join(engine.vocabulary(), "term")
    expected = rows.groupBy("topic", "term").agg(F.count("*").alias("f"), F.sum(1 - F.pow(1 - chance, F.col("gap"))).alias("e")).where("f > 1")
    score = F.col("f") * F.log(F.col("f") / F.col("e"))
    return expected.select("topic", "term", F.round(score, 6).alias("score"), score.alias("raw")).where("raw > 0").drop("raw")


def text_covers(engine: Engine, query: DataFrame, depth: int) -> DataFrame:
    """(topic, doc_id, score, p, q): the best cover of each topic's words in each document, the best ``depth`` of each topic."""
    weights = rk.term_weights(query, engine.vocabulary())
    if rk._few(query):
        return rk.best_covers(engine.lists(), weights.withColumnRenamed("w", "factor"), depth)
    places = engine.plain.join(weights, "term")
    return rk.ranked(rk.topic_covers(places), depth, digits=9).drop("rank")


def cross_feedback(first: Engine, second: Engine, query: DataFrame, expansions: int = 16, depth: int = 32, window: int = 64, stem: bool = False, k1: float = 1.18281, b: float = 0.447428, most: int = 1000) -> DataFrame:
    """(topic, doc_id, rank): documents of ``second``, ranked by terms that ``first`` tells.

    In one collection, the words around the best covers of each topic are weighed against chance, and the
    best ``expansions`` of them are the topic's new query, by stem with their weights added up if ``stem``; it ranks the
    other collection by BM25.
    """
    near = window_feedback(first, first.shared(text_covers(first, query, depth)), window)
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "term")
    best = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= expansions)
    new = best.select("topic", "term", F.col("score").alias("weight"))
    if stem:
        stems = tx.stems(new)
        changed = F.when(F.col("stem") == F.col("term"), F.col("term")).otherwise(F.concat(F.lit("porter:"), "stem"))
        new = new.join(stems, "term").select("topic", changed.alias("term"), "weight").groupBy("topic", "term").agg(F.sum("weight").alias("weight"))
    new = rk.made_of(first.shared(new), query, expansions)  # read by several jobs
    return rk.best_bm25(second.statistics(new, stem), new, most, k1, b)


def stopped(query: DataFrame) -> DataFrame:
    """Query terms without stop words; a topic of stop words only stays as it is."""
    stop = F.col("term").isin(*STOPWORDS)
    whole = F.min(stop.cast("int")).over(Window.partitionBy("topic")) == 1
    return rk.made_of(query.withColumn("whole", whole).where(~stop | F.col("whole")).drop("whole"), query)


class Pipeline:
    """Stages split by white space: ``stop``, ``stem``, ``bm25``, ``lmd``, ``rsj``, ``kld``; ``name=value``
    sets a parameter of all later stages, ``stage:name=value,...`` of one stage.

    ``rsj`` and ``kld`` add words as they stand in the ranked documents, so where words are stemmed a ``stem`` follows them. ``rsj``
    adds the same weight, ``gamma``, to each of its terms, or with ``scaled=1`` a weight that falls with the term's score."""

    def __init__(self, text: str) -> None:
        self.stages: list[tuple[str, dict[str, float]]] = []
        shared: dict[str, float] = {}
        for word in text.split():
            if "=" in word and ":" not in word:
                name, value = word.split("=", 1)
                shared = shared | {name: float(value)}
                continue
            name, _, own = word.partition(":")
            if name not in ("stop", "stem", "bm25", "lmd", "rsj", "kld"):
                raise ValueError(f"unknown stage: {name}")
            self.stages.append((name, shared | {k: float(v) for k, v in (x.split("=") for x in own.split(",") if x)}))

    def run(self, engine: Engine, topics: DataFrame) -> DataFrame:
        """(topic, doc_id, score, rank) of the last ranking."""
        query, run = rk.query_terms(topics), None
        stems, length = False, engine.lengths()
        for name, p in self.stages:
            if name == "stop":
                query = stopped(query)
            elif name == "stem":
                stem = tx.stems(query)
                changed = F.when(F.col("stem") == F.col("term"), F.col("term")).otherwise(F.concat(F.lit("porter:"), "stem"))
                bare = query.where(~F.col("term").startswith("porter:")).join(stem, "term").select("topic", changed.alias("term"), "weight")
                both = bare.unionByName(query.where(F.col("term").startswith("porter:")))
                query = rk.made_of(both.groupBy("topic", "term").agg(F.sum("weight").alias("weight")), query)
                stems = True
            elif name == "bm25":
                run = rk.best_bm25(engine.statistics(query, stems), query, int(p.get("depth", 1000)), p.get("k1", 0.5), p.get("b", 0.25))
            elif name == "lmd":
                run = rk.best_lmd(engine.statistics(query, stems), query, int(p.get("depth", 1000)), p.get("mu", 2000.0))
            else:
                depth, most, gamma = (10, 25, 0.2) if name == "rsj" else (16, 8, 1 / 3)
                run = engine.shared(run)
                spans = run.where(F.col("rank") <= int(p.get("depth", depth))).join(length, "doc_id").select("topic", "doc_id", F.lit(0).cast("long").alias("p"), (F.col("len") - 1).alias("q"))
                expansions, even = int(p.get("expansions", most)), name == "rsj" and not p.get("scaled")
                more = rk.feedback(engine.tokens_of(spans), engine.vocabulary(), spans, expansions, name, p.get("gamma", gamma), even)
                query = rk.made_of(engine.shared(rk.expanded(query, more, expansions)), query, 1 + expansions)  # read by several jobs
        return run.select("topic", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def tf_idf_weight(tf: float, df: float, items: float) -> float:
    """The weight a tf-idf annotation holds."""
    return tf * math.log(items / df) if df else 0.0
