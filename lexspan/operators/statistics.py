"""Choice of the statistics that rankers read, by name and recipe, or by the parameters of a collection.

``df`` (or ``tf``) reads the stored counts of whole documents. ``idf`` counts inside the containers that its recipe, an interval
expression, finds: they are then what is ranked. ``field`` adds up counts inside annotated fields, each with the weight that its
recipe gives it. ``tf-idf`` takes the annotations of a forager. All give the same two tables, so any
ranker works over any of them; what is ranked is ``doc_id``, or for containers the struct (doc_id, p, q).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators import ranking as rk
from lexspan.plans.engine import Engine
from lexspan.plans.gcl import parse


class NoStatistics(ValueError):
    """Nothing tells which statistics a collection has."""


def select(engine: Engine, parameters: dict[str, str], query: DataFrame, name: str = "", recipe: str = "") -> rk.Statistics:
    """The statistics of a query's terms. Without a name: those of a forager if the collection has its annotations
    (``foraged``), else those that the parameter ``statistics`` names, else ``idf`` if there is a ``container``."""
    if not name:
        if parameters.get("foraged"):
            name = "tf-idf"
        elif parameters.get("statistics"):
            name = parameters["statistics"]
        elif parameters.get("container"):
            name = "idf"
        else:
            raise NoStatistics("no ranking statistics available")
    if name in ("df", "tf"):
        return engine.statistics(query)
    if name == "idf":
        return contained(engine, query, recipe or parameters.get("container") or ":item")
    if name == "field":
        return fielded(engine, query, weights_of(recipe))
    if name == "tf-idf":
        return foraged(engine, query)
    raise NoStatistics(f"no statistics called {name}")


def weights_of(recipe: str) -> dict[str, float]:
    """``:title:=2 :body:=1`` as a dictionary."""
    try:
        found = {name: float(weight) for name, weight in (part.rsplit("=", 1) for part in recipe.split())}
    except ValueError as e:
        raise NoStatistics(f"no field recipe: {recipe!r}") from e
    if not found:
        raise NoStatistics("a field recipe names a field at least")
    return found


def places_of(engine: Engine, query: DataFrame) -> DataFrame:
    """(doc_id, p, q, term) of the query's words."""
    found = rk.matching(engine.plain, query)
    return found.select("doc_id", F.col("pos").alias("p"), F.col("pos").alias("q"), "term")


def with_totals(tf: DataFrame, lengths: DataFrame) -> rk.Statistics:
    """Document frequencies of ``tf`` beside the totals of ``lengths``, one row."""
    terms = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return tf, terms.crossJoin(F.broadcast(lengths))


def contained(engine: Engine, query: DataFrame, container: str) -> rk.Statistics:
    """Counts inside the intervals of an expression, which are ranked; their lengths are those of the intervals."""
    units = engine.shared(engine.gcl(parse(container)).select("doc_id", "p", "q").distinct())
    # a document without a container has nothing to count
    places = places_of(engine, query).join(units.select("doc_id").distinct(), "doc_id", "left_semi")
    held = rk.inside(places, units)
    unit = F.struct("doc_id", F.col("container_p").alias("p"), F.col("container_q").alias("q")).alias("doc_id")
    tf = held.groupBy(unit, "term").agg(F.count("*").alias("tf"))
    # read for the document frequencies, and again for the scores
    tf = engine.shared(tf.select("term", "doc_id", "tf", (F.col("doc_id.q") - F.col("doc_id.p") + 1).alias("len")))
    size = F.col("q") - F.col("p") + 1
    totals = units.agg(F.count("*").alias("items"), F.sum(size).alias("length"), F.avg(size).alias("avgl"))
    return with_totals(tf, totals)


def fielded(engine: Engine, query: DataFrame, weights: dict[str, float]) -> rk.Statistics:
    """Counts inside annotated fields, each times its weight, added up by document."""
    places = places_of(engine, query)
    parts = [rk.inside(places, engine.leaf(name).select("doc_id", "p", "q")).select("term", "doc_id", "p", F.lit(weight).alias("weight")).distinct() for name, weight in weights.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    tf = rows.groupBy("term", "doc_id").agg(F.sum("weight").alias("tf")).where("tf > 0")
    lengths = engine.lengths()
    return with_totals(tf.join(lengths, "doc_id").select("term", "doc_id", "tf", "len"), rk.sums(lengths))


def foraged(engine: Engine, query: DataFrame) -> rk.Statistics:
    """A forager's annotations ``@tf-idf:tf:word`` at the start of documents, instead of words."""
    prefix = "@tf-idf:tf:"
    terms = query.select("term").distinct()
    own = engine.annotations.where(F.col("feature").startswith(prefix)).select(F.substring("feature", len(prefix) + 1, 1 << 30).alias("term"), "doc_id", F.col("v").alias("tf"))
    lengths = engine.lengths()
    tf = own.join(terms, "term", "left_semi").join(lengths, "doc_id").select("term", "doc_id", "tf", "len")
    return with_totals(tf, rk.sums(lengths))
