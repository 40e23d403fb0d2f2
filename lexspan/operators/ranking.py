"""Statistics and ranking functions over tokens (doc_id, term, pos); one row of scores a topic and document.

Queries are (topic, term, weight) tables, so any number of topics is ranked by one job: a join of
term frequencies with the few query terms and one aggregation. Logarithms are natural.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspan.functions import text as tx
from lexspan.operators.topk import best, best_covers, covers


def term_frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id").agg(F.count("*").alias("len"))


def totals(tokens: DataFrame) -> DataFrame:
    """One row: items, total length, mean length, distinct terms."""
    return tokens.agg(F.countDistinct("doc_id").alias("items"), F.count("*").alias("length"), F.countDistinct("term").alias("vocab")).withColumn("avgl", F.col("length") / F.col("items"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(n / df))


def rsj(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5)))


def query_terms(topics: DataFrame, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """(topic, term, weight): how often each word stands in each topic's text."""
    return tx.tokens(topics, text_col, id_col).groupBy(F.col("doc_id").alias("topic"), "term").agg(F.count("*").cast("double").alias("weight"))


def sums(length: DataFrame) -> DataFrame:
    """One row of the lengths of documents: items, total length, mean length."""
    return length.agg(F.count("*").alias("items"), F.sum("len").alias("length")).withColumn("avgl", F.col("length") / F.col("items"))


def matching(tokens: DataFrame, query: DataFrame) -> DataFrame:
    """The tokens that are terms of the query: few are left before anything is shuffled."""
    terms = query.select("term").distinct()
    return tokens.join(F.broadcast(terms) if _few(query) else terms, "term", "left_semi")


def weighted_terms(query: DataFrame, terms: DataFrame) -> DataFrame:
    """Query terms with the rsj weight of each, those of weight 0 left out; ``terms`` as of ``statistics``."""
    return query.join(terms, "term").withColumn("rsj", rsj(F.col("items"), F.col("df"))).where("rsj > 0")


#: Rows of a query that may be broadcast, counted or bounded by what it was made of.
FEW = 1_000_000


def size_of(query: DataFrame, most: int = FEW) -> int:
    """The number of rows, or ``most`` + 1 if there are more; a table is counted once."""
    if not hasattr(query, "lexspan_rows"):
        query.lexspan_rows = query.limit(most + 1).count()
    return query.lexspan_rows


def made_of(made: DataFrame, query: DataFrame, times: int = 1) -> DataFrame:
    """``made``, which has at most ``times`` as many rows as ``query``, so that it needs no count of its own."""
    made.lexspan_rows = size_of(query) * times
    return made


def _few(query: DataFrame) -> bool:
    """Whether the rows are few enough to broadcast."""
    return size_of(query) <= FEW


Statistics = tuple[DataFrame, DataFrame]


def statistics(tokens: DataFrame, query: DataFrame, length: DataFrame | None = None) -> Statistics:
    """What rankers read, from tokens: (term, doc_id, tf, len) of the query's terms, and (term, df, cf) with the collection's
    items, length and avgl. A stored index has the same, see ``lexspan.plans.engine``."""
    tf = term_frequencies(matching(tokens, query))
    length = lengths(tokens) if length is None else length
    terms = document_frequencies(tf).crossJoin(F.broadcast(sums(length).select("items", "length", "avgl")))
    return tf.join(length, "doc_id"), terms


def scored(tf: DataFrame, terms: DataFrame, query: DataFrame, gain: Column) -> DataFrame:
    """(topic, doc_id, score): the gains of a document's postings added up. The query's terms go to the postings."""
    return tf.join(F.broadcast(terms) if _few(query) else terms, "term").groupBy("topic", "doc_id").agg(F.sum(gain).alias("score"))


def bm25(stats: Statistics, query: DataFrame, k1: float = 0.5, b: float = 0.25) -> DataFrame:
    """(topic, doc_id, score)."""
    tf, terms = stats
    gain = F.col("weight") * F.col("rsj") * F.col("tf") / (k1 * ((1 - b) + b * F.col("len") / F.col("avgl")) + F.col("tf"))
    return scored(tf, weighted_terms(query, terms), query, gain)


def lmd(stats: Statistics, query: DataFrame, mu: float = 2000.0) -> DataFrame:
    """Language model with Dirichlet smoothing over the matching terms; scores above 0."""
    tf, terms = stats
    gain = F.col("weight") * (F.log(mu + F.col("tf") * F.col("length") / F.col("cf")) - F.log(mu + F.col("len")))
    return scored(tf, query.join(terms, "term"), query, gain).where("score > 0")


def best_bm25(stats: Statistics, query: DataFrame, depth: int, k1: float = 0.5, b: float = 0.25) -> DataFrame:
    """``ranked(bm25(...), depth)``, without the scores of other documents."""
    if not _few(query):
        return ranked(bm25(stats, query, k1, b), depth)
    return best_bm25_of(stats, query, depth, [(k1, b)]).drop("trial")


def best_bm25_of(stats: Statistics, query: DataFrame, depth: int, settings: list[tuple[float, float]]) -> DataFrame:
    """(trial, topic, doc_id, score, rank): the best by BM25 under each setting (k1, b), in one pass over the postings of few query terms."""
    tf, terms = stats
    weights = weighted_terms(query, terms).select("topic", "term", (F.col("weight") * F.col("rsj")).alias("factor"), "avgl")
    gain = [F.col("tf") / (k1 * ((1 - b) + b * F.col("len") / F.col("avgl")) + F.col("tf")) for k1, b in settings]
    return best(tf, weights, depth, gain)


def best_lmd(stats: Statistics, query: DataFrame, depth: int, mu: float = 2000.0) -> DataFrame:
    """``ranked(lmd(...), depth)``, without the scores of other documents."""
    if not _few(query):
        return ranked(lmd(stats, query, mu), depth)
    tf, terms = stats
    weights = query.join(terms, "term").select("topic", "term", F.col("weight").alias("factor"), "cf", "length")
    gain = F.log(mu + F.col("tf") * F.col("length") / F.col("cf")) - F.log(mu + F.col("len"))
    return best(tf, weights, depth, [gain], above=0.0).drop("trial")


def dot_product(values: DataFrame, query: DataFrame) -> DataFrame:
    """Sum of query weight times value over shared features; ``values`` has (doc_id, term, value)."""
    return values.join(query, "term").groupBy("topic", "doc_id").agg(F.sum(F.col("weight") * F.col("value")).alias("score")).where("score > 0")


#: Vectors that are multiplied at once with as many queries, and queries whose results are passed on at once.
BLOCK, ROWS = 2048, 64


def vector_products(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``dot_product`` of whole vectors, (doc_id, vector): (topic, doc_id, score) of all pairs with a score above 0.

    Blocks of vectors meet blocks of queries, and what a pair of blocks gives is the result: no pair of vectors is shuffled. Features that are
    null or beyond the shorter vector don't count. Ids must not repeat among the vectors, nor among the queries.
    """
    schema = queries.select(F.col("doc_id").alias("topic")).crossJoin(vectors.select("doc_id")).withColumn("score", F.lit(0.0)).schema

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        n = rows.count() // BLOCK + 1
        numbered = rows.where("vector is not null").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
        return numbered.repartition(n, "block").groupBy("block").agg(F.collect_list(F.struct("doc_id", "vector")).alias(name)).select(name)

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (ids, x, known), (topics, y, asked) = (_matrix(batch.column(i).slice(k, 1).flatten()) for i in (0, 1))
                width = min(x.shape[1], y.shape[1])
                x, known, y, asked = x[:, :width], known[:, :width], y[:, :width], asked[:, :width]
                plain = bool(np.isfinite(x).all() and np.isfinite(y).all())
                for a in range(0, len(y), ROWS):
                    part, told = y[a : a + ROWS], asked[a : a + ROWS]
                    with np.errstate(invalid="ignore", over="ignore"):
                        score = part @ x.T if plain else sum((np.where(told[:, [f]] & known[:, f], part[:, [f]] * x[:, f], 0.0) for f in range(width)), np.zeros((len(part), len(x))))
                    # a sum that is no number counts as above 0, as in a comparison of SQL
                    q, d = np.nonzero((score > 0) | np.isnan(score))
                    yield pa.RecordBatch.from_arrays([topics.take(pa.array(q + a)), ids.take(pa.array(d)), pa.array(score[q, d])], names=["topic", "doc_id", "score"])

    return blocks(vectors, "own").crossJoin(blocks(queries, "asked")).mapInArrow(work, schema)


def _matrix(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, vectors as rows of equal length, and which of their values are there."""
    ids, lists = rows.flatten()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    there = np.arange(size.max(initial=0)) < size[:, None]
    x, known = np.zeros(there.shape), there.copy()
    x[there] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    known[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    return ids, x, known


def cover_density(covers: DataFrame, k: float = 42.0, containers: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, p, q): per container the sum of 1 / (k + q - p) over the covers inside, and
    the shortest cover, the first on a tie."""
    gain = 1 / (k + F.col("q") - F.col("p"))
    best = F.min(F.struct((F.col("q") - F.col("p")).alias("size"), "p", "q")).alias("best")
    if containers is None:
        found = covers.groupBy("doc_id").agg(F.sum(gain).alias("score"), best)
        return found.select("doc_id", "score", "best.p", "best.q")
    found = inside(covers, containers).groupBy("doc_id", "container_p", "container_q").agg(F.sum(gain).alias("score"), best)
    return found.select("doc_id", "container_p", "container_q", "score", "best.p", "best.q")


def inside(covers: DataFrame, containers: DataFrame) -> DataFrame:
    """(doc_id, container_p, container_q, p, q and what else a cover has): each cover with each container that holds it.
    Containers may overlap and be nested.

    Covers are minimal, so those inside a container are neighbours: from the first that starts in it to the last that
    ends in it. One sweep over all ends of a document numbers the covers and tells each container these two numbers; the numbers
    in between are joined, so every joined row is a result.
    """
    rest = [c for c in covers.columns if c != "doc_id"]
    c = containers.select("doc_id", F.struct(F.col("p").alias("container_p"), F.col("q").alias("container_q")).alias("box")).distinct()
    own = covers.select("doc_id", F.struct(*rest).alias("own"))
    null = lambda rows, name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    end = lambda rows, at, kind: rows.select("doc_id", F.col(at).alias("at"), F.lit(kind).alias("kind"), *[x if x in rows.columns else null({"own": own, "box": c}[x], x) for x in ("own", "box")])
    ends = end(own, "own.p", "start").unionByName(end(own, "own.q", "end")).unionByName(end(c, "box.container_p", "from")).unionByName(end(c, "box.container_q", "to"))
    order = Window.partitionBy("doc_id").orderBy("at")
    count = lambda kind, last: F.count(F.when(F.col("kind") == kind, 1)).over(order.rangeBetween(Window.unboundedPreceding, last))
    swept = ends.withColumns({"before": count("start", -1), "upto": count("end", 0)})
    numbered = swept.where("kind = 'start'").select("doc_id", (F.col("before") + 1).alias("n"), "own")
    held = swept.where("kind in ('from', 'to')").groupBy("doc_id", "box").agg(
        (F.max(F.when(F.col("kind") == "from", F.col("before"))) + 1).alias("first"), F.max(F.when(F.col("kind") == "to", F.col("upto"))).alias("last")
    )
    wanted = held.where("first <= last").select("doc_id", "box", F.explode(F.sequence("first", "last")).alias("n"))
    return wanted.join(numbered, ["doc_id", "n"]).select("doc_id", "box.container_p", "box.container_q", "own.*")


def attached(results: DataFrame, containers: DataFrame) -> DataFrame:
    """``results`` (doc_id, p, q and more) with the container that ends first at or after q, (container_p, container_q); null if none
    does. A window over the ends of a document; of containers with one end the last to start."""
    none = F.lit(None).cast("long")
    rest = [c for c in results.columns if c != "doc_id"]
    c = containers.groupBy("doc_id", "q").agg(F.max("p").alias("p"))
    at = c.select("doc_id", F.col("q").alias("at"), F.struct(F.col("q").alias("container_q"), F.col("p").alias("container_p")).alias("own"), F.lit(None).cast(results.select(F.struct(*rest)).schema[0].dataType).alias("row"))
    rows = results.select("doc_id", F.col("q").alias("at"), F.lit(None).cast(at.schema["own"].dataType).alias("own"), F.struct(*rest).alias("row"))
    ahead = Window.partitionBy("doc_id").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    found = at.unionByName(rows).withColumn("held", F.min("own").over(ahead)).where("row is not null")
    return found.select("doc_id", "row.*", "held.container_p", "held.container_q")


def ranked(scores: DataFrame, depth: int, by: str = "topic", digits: int = 6) -> DataFrame:
    """The best ``depth`` of each topic with their rank; ties by doc_id."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def top(scores: DataFrame, depth: int, digits: int = 6) -> DataFrame:
    """The best ``depth`` of one ranking; ties by doc_id."""
    return scores.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "doc_id").limit(depth)


def reciprocal_rank_fusion(runs: DataFrame, k: int = 60) -> DataFrame:
    """``runs`` has (topic, doc_id, rank) of any number of rankings."""
    return runs.groupBy("topic", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def merged(*rankings: DataFrame, depth: int) -> DataFrame:
    """The best hit of each document over shards, then the best of all."""
    rows = rankings[0]
    for r in rankings[1:]:
        rows = rows.unionByName(r)
    return top(rows.groupBy("doc_id").agg(F.max("score").alias("score")), depth)


def build_tiers(weights: dict[str, float], gap: float = 1.0, most: int = 16) -> list[str]:
    """Tiers of all subsets of the heaviest terms, heaviest first; subsets closer than ``gap`` share one."""
    terms = sorted(weights, key=lambda t: (-weights[t], t))[:most]
    subsets = [(sum(weights[t] for t in c), c) for n in range(len(terms), 0, -1) for c in combinations(terms, n)]
    subsets.sort(key=lambda s: (-s[0], s[1]))
    tiers: list[list[str]] = []
    last = None
    for weight, c in subsets:
        text = f"(... {c[0]} {c[0]})" if len(c) == 1 else f"(^ {' '.join(c)})"
        if last is None or last - weight >= gap:
            tiers.append([])
            last = weight
        tiers[-1].append(text)
    return [t[0] if len(t) == 1 else f"(+ {' '.join(t)})" for t in tiers]


def term_weights(query: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(topic, term, w): the weight in covers of each topic's terms that occur."""
    w = F.log((F.col("length") + F.col("vocab")) / (F.col("cf") + 1))
    return query.select("topic", "term").distinct().join(vocabulary, "term").select("topic", "term", w.alias("w"))


def topic_covers(places: DataFrame) -> DataFrame:
    """(topic, doc_id, score, p, q): for each topic and document the best of the covers that ``icover`` scores.

    ``places`` has (topic, doc_id, term, pos, w).
    """
    rows = places.groupBy("topic", "doc_id").agg(F.collect_list(F.struct("pos", "term", "w")).alias("spots"))
    schema = rows.select("topic", "doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q")).schema

    def work(batches):
        for batch in batches:
            spots = batch.column(2)
            pos, term, w = spots.flatten().flatten()
            found = covers(pc.list_parent_indices(spots).to_numpy(), pos.to_numpy(), term.dictionary_encode().indices.to_numpy().astype(np.int64), w.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found)], names=["topic", "doc_id", "score", "p", "q"])

    return rows.mapInArrow(work, schema)


def icover(tokens: DataFrame, query: list[str], total: float, vocab: float, frequencies: dict[str, float], depth: int) -> DataFrame:
    """(doc_id, score, p, q): the best of the covers of n of the query's terms, by the sum of their weights less n
    times the log of the length, for n of 2 or more and scores above 0, and of single terms by weight.

    One backward pass over the places of a document's query terms finds the next place of each term; the n
    nearest of them are the cover of n terms from that place.
    """
    weights = {t: math.log((total + vocab) / (frequencies.get(t, 0.0) + 1)) for t in query}
    own = tokens.where(F.col("term").isin(*weights)).select("doc_id", "term", "pos")
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    after = [F.struct(F.min(F.when(F.col("term") == t, F.col("pos"))).over(back).alias("at"), F.lit(w).alias("w")) for t, w in weights.items()]
    near = own.select("doc_id", "pos", F.array_sort(F.filter(F.array(*after), lambda x: x["at"].isNotNull())).alias("near"))
    weight = lambda n: F.aggregate(F.slice("near", 1, n), F.lit(0.0), lambda s, x: s + x["w"])
    end = lambda n: F.element_at("near", n)["at"]
    score = lambda n: F.round(weight(n) - F.when(n > 1, n * F.log(end(n) - F.col("pos") + 1)).otherwise(0.0), 9)
    cover = lambda n: F.when((n == 1) | (score(n) > 0), F.struct((-score(n)).alias("loss"), F.col("pos").alias("p"), end(n).alias("q")))
    every = near.select("doc_id", F.array_min(F.transform(F.sequence(F.lit(1), F.size("near")), cover)).alias("best"))
    found = every.groupBy("doc_id").agg(F.min("best").alias("best"))
    return top(found.select("doc_id", (-F.col("best.loss")).alias("score"), "best.p", "best.q"), depth, 9)


def feedback(inside: DataFrame, vocabulary: DataFrame, ranking: DataFrame, expansions: int, score: str, gamma: float, even: bool = False) -> DataFrame:
    """Expansion terms (topic, term, weight) from the ranked passages of each topic.

    ``ranking`` has (topic, doc_id, p, q), ``inside`` the tokens of its documents, ``vocabulary`` (term, df, cf) with totals. ``score`` is
    "kld": f ln(f / E) with E the passages expected to hold the term by its frequency, f above 1; or "rsj": f times the rsj
    weight. The weight is gamma times the score over the topic's best, or gamma for every term if ``even``.
    """
    own = inside.join(ranking.select("topic", "doc_id", "p", "q"), "doc_id").where("pos between p and q")
    counts = own.groupBy("topic", "term").agg(F.countDistinct("doc_id", "p").alias("f"))
    sizes = ranking.select("topic", (F.col("q") - F.col("p") + 1).alias("n"))
    if score == "kld":
        share = F.col("cf") / F.col("length")
        expected = counts.where("f > 1").join(vocabulary, "term").join(sizes, "topic").groupBy("topic", "term", "f").agg(F.sum(1 - F.pow(1 - share, F.col("n"))).alias("e"))
        made = expected.withColumn("score", F.col("f") * F.log(F.col("f") / F.col("e")))
    else:
        made = counts.join(vocabulary, "term").withColumn("score", F.col("f") * rsj(F.col("items"), F.col("df")))
    made = made.where("score > 0").withColumn("score", F.round("score", 9))
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "term")
    best = F.max("score").over(Window.partitionBy("topic"))
    kept = made.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.lit(gamma) if even else gamma * F.col("score") / best).where(F.col("rank") <= expansions)
    return kept.select("topic", "term", "weight")


def expanded(query: DataFrame, more: DataFrame, expansions: int) -> DataFrame:
    """The query with at most ``expansions`` further terms for each topic, weights added up."""
    return made_of(query.unionByName(more).groupBy("topic", "term").agg(F.sum("weight").alias("weight")), query, 1 + expansions)
