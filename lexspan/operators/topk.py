"""The best documents of many topics without a table of all pairs of topic and document.

A score is a sum over terms of a weight of topic and term times a gain of term and document. Gains are grouped by document with one
exchange; a task adds up the scores of a piece of its documents at a time and passes on only those that can be among the best of
a topic: at most ``depth`` of each topic and piece, and later pieces only what is above the least of an earlier ``depth``. What is passed on
is ranked as a whole, so the result is that of ranking every pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Products of weight and gain that a task holds at once, besides those of one document.
PIECE = 2_000_000
#: The same where covers are looked for, each term with all its places.
COVERED = 200_000


def changes(col: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    if pa.types.is_struct(col.type):
        return np.logical_or.reduce([changes(c) for c in col.flatten()])
    null = np.asarray(col.is_null())
    new = np.ones(len(col), bool)
    new[1:] = np.asarray(pc.fill_null(pc.not_equal(col[1:], col[:-1]), False)) | (null[1:] != null[:-1])
    return new


class Weights:
    """(topic, term, factor, ...) as arrays: the topics and factors of term n are at ``first[n]`` to ``first[n + 1]``. Few: the driver and each worker hold them."""

    def __init__(self, weights: DataFrame) -> None:
        own = weights.toArrow()
        topics, terms = (own[c].combine_chunks().dictionary_encode() for c in ("topic", "term"))
        order = np.argsort(terms.indices.to_numpy(), kind="stable")
        self.topic, self.factor = topics.indices.to_numpy()[order].astype(np.int64), own["factor"].to_numpy()[order]
        self.first = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(terms.dictionary) + 1))
        self.count, spark = len(topics.dictionary), weights.sparkSession
        named = own.take(order[self.first[:-1]]).drop_columns(["topic", "factor"]).append_column("lexspan_n", pa.array(np.arange(len(terms.dictionary)), pa.int32()))
        #: (term, ..., lexspan_n) and (at, topic)
        self.known = F.broadcast(spark.createDataFrame(named, weights.drop("topic", "factor").schema.add("lexspan_n", "integer")))
        self.names = F.broadcast(spark.createDataFrame(list(enumerate(topics.dictionary.to_pylist())), weights.select(F.lit(0).alias("at"), "topic").schema))


def pieces(batches, first: np.ndarray, size: int):
    """Pieces of whole documents of batches (doc_id, lexspan_n, ...) in order of doc_id: the documents, the number of each row's document, and the
    rows. A piece has at most ``size`` pairs of a row and a topic, besides those of one document."""
    held = None
    for batch in [*_grouped(batches), None]:
        if batch is not None:
            held = batch if held is None else pa.concat_batches([held, batch])
        if held is None or not held.num_rows:
            continue
        starts = np.flatnonzero(changes(held.column(0)))
        whole = len(starts) - (batch is not None)  # the last document may go on
        n = held.column(1).to_numpy()
        made = np.concatenate([[0], np.cumsum(first[n + 1] - first[n])])
        ends = np.append(starts, len(n))
        k = 0
        while k < whole:
            to = max(k + 1, min(whole, int(np.searchsorted(made[ends], made[ends[k]] + size, "right")) - 1))
            doc = np.repeat(np.arange(to - k), np.diff(ends[k : to + 1]))
            yield held.column(0).take(pa.array(starts[k:to])), doc, held.slice(ends[k], ends[to] - ends[k])
            k = to
        held = held.slice(ends[whole])


def spread(times: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row as many entries as ``times`` says: the row, and the entry, counted on from the row's ``start``."""
    row = np.repeat(np.arange(len(times)), times)
    return row, np.arange(len(row)) + np.repeat(start - np.cumsum(times) + times, times)


def passed_on(pair, topic, score, depth: int, least: np.ndarray) -> np.ndarray:
    """Which entries can be among the best ``depth`` of their topics, best first; ``least`` is raised where a piece has so many. Documents
    come in order, so what ties with the least of an earlier piece stands behind it."""
    hold = np.flatnonzero(score > least[topic])
    by = hold[np.lexsort((pair[hold], -score[hold], topic[hold]))]
    rank = np.arange(len(by)) - np.searchsorted(topic[by], topic[by])
    last = by[rank == depth - 1]
    least[topic[last]] = score[last]
    return by[rank < depth]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10**digits + 0.5) / 10**digits


def best(gains: DataFrame, weights: DataFrame, depth: int, value: list[Column], digits: int = 6, above: float | None = None) -> DataFrame:
    """(trial, topic, doc_id, score, rank) for each column of ``value``, a gain over the columns of ``gains`` (term, doc_id, ...) and what
    ``weights`` (topic, term, factor, ...) tells of a term. Ties of rounded scores go by doc_id. The weights must be few.
    ``above`` leaves out scores that are not above it."""
    own, piece, width = Weights(weights), PIECE, len(value)
    topic_of, factor, first, count = own.topic, own.factor, own.first, own.count
    schema = gains.select(F.lit(0).alias("trial"), F.lit(0).alias("at"), "doc_id", F.lit(0.0).alias("score")).schema

    def work(batches):
        least = np.full((width, count), -np.inf)
        for docs, doc, rows in pieces(batches, first, piece):
            n = rows.column(1).to_numpy()
            row, at = spread(first[n + 1] - first[n], first[n])
            key = topic_of[at] * len(docs) + doc[row]
            if count * len(docs) <= 4 * len(key):
                seen = np.zeros(count * len(docs), bool)
                seen[key] = True
                pair = np.flatnonzero(seen)
                summed = lambda x, key=key, pair=pair, size=len(seen): np.bincount(key, x, size)[pair]
            else:
                pair, key = np.unique(key, return_inverse=True)
                summed = lambda x, key=key: np.bincount(key, x)
            for trial in range(width):
                raw = summed(factor[at] * rows.column(2 + trial).to_numpy()[row])
                real = np.flatnonzero(raw > above) if above is not None else np.arange(len(raw))
                p, t, s = pair[real], pair[real] // len(docs), rounded(raw[real], digits)
                kept = passed_on(p, t, s, depth, least[trial])
                columns = [pa.array(np.full(len(kept), trial), pa.int32()), pa.array(t[kept], pa.int32()), docs.take(pa.array(p[kept] % len(docs))), pa.array(s[kept])]
                yield pa.RecordBatch.from_arrays(columns, names=["trial", "at", "doc_id", "score"])

    rows = gains.join(own.known, "term").select("doc_id", "lexspan_n", *[v.cast("double").alias(f"v{i}") for i, v in enumerate(value)])
    found = rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(work, schema)
    by = Window.partitionBy("trial", "at").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= depth)
    return ranked.join(own.names, "at").select("trial", "topic", "doc_id", "score", "rank")


def best_covers(lists: DataFrame, weights: DataFrame, depth: int) -> DataFrame:
    """(topic, doc_id, score, p, q): the best cover of each topic in a document, see ``covers``, the best ``depth`` documents of each topic.
    ``lists`` has (term, doc_id, places). No cover weighs more than all terms that a document has, so the places of a document are looked at only
    if that sum can be among the best. Pieces are small, so that a task soon knows scores that later documents have to reach."""
    own, piece = Weights(weights), COVERED
    topic_of, factor, first, count = own.topic, own.factor, own.first, own.count
    schema = lists.select(F.lit(0).alias("at"), "doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q")).schema

    def work(batches):
        least = np.full(count, -np.inf)
        for docs, doc, rows in pieces(batches, first, piece):
            n, places = rows.column(1).to_numpy(), rows.column(2)
            flat, size = places.flatten().to_numpy(), pc.list_value_length(places).to_numpy()
            row, at = spread(first[n + 1] - first[n], first[n])
            pair, key = np.unique(topic_of[at] * len(docs) + doc[row], return_inverse=True)
            most = np.bincount(key, np.maximum(factor[at], 0))
            open_ = np.flatnonzero(most[key] + 1e-6 >= least[pair // len(docs)][key])
            if not len(open_):
                continue
            pair, key = np.unique(pair[key[open_]], return_inverse=True)
            term, place = spread(size[row[open_]], (np.cumsum(size) - size)[row[open_]])
            score, p, q = covers(key[term], flat[place].astype(np.int64), n[row[open_]][term], factor[at[open_]][term], least[pair // len(docs)])
            kept = passed_on(pair, pair // len(docs), score, depth, least)
            columns = [pa.array(pair[kept] // len(docs), pa.int32()), docs.take(pa.array(pair[kept] % len(docs))), *(pa.array(x[kept]) for x in (score, p, q))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "doc_id", "score", "p", "q"])

    rows = lists.join(own.known, "term").select("doc_id", "lexspan_n", "places")
    found = rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(work, schema)
    by = Window.partitionBy("at").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= depth)
    return ranked.join(own.names, "at").select("topic", "doc_id", "score", "p", "q")


#: Cells of the table of next places that ``covers`` makes at once, besides those of one group.
CELLS = 2_000_000


def covers(group: np.ndarray, pos: np.ndarray, term: np.ndarray, w: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, p, q) of the best cover of each group 0, 1, ... of places with the number and weight of their term: by the sum of the weights less n
    times the log of the length for n of 2 or more terms and scores above 0, and of single terms by weight. From each place the
    n nearest next places of terms are the cover of n terms; ties go by p, then q.

    ``least`` is a score for each group: groups whose best is below it may get any score below it. Each term of a cover adds its weight less the
    log of the cover's length, and so no more than its weight less the log of its own distance; places where these sums are below are left out."""
    order = np.lexsort((pos, group))
    group, pos, term, w = group[order], pos[order], term[order], w[order]
    kinds, kind = np.unique(group * (int(term.max()) + 1) + term, return_inverse=True)
    weight = np.zeros(len(kinds))
    weight[kind] = w
    from_ = np.searchsorted(kinds // (int(term.max()) + 1), np.arange(group[-1] + 2))  # the terms of each group
    terms, end = np.diff(from_), np.searchsorted(group, np.arange(group[-1] + 1), "right")
    local = kind - from_[group]
    score, first, last = np.full(len(terms), -np.inf), np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for m in np.unique(terms[terms > 0]):
        all_ = np.flatnonzero(terms[group] == m)
        cuts = np.searchsorted(group[all_], group[all_][:: max(1, CELLS // int(m))])
        for a, b in zip(cuts, [*cuts[1:], len(all_)], strict=True):
            own = all_[a:b]
            if not len(own):
                continue
            g, here, none = group[own], pos[own], len(own)
            # groups are neighbours in ``own`` too; where each ends
            stop = np.searchsorted(g, g, "right")
            far, ahead, start, bound = here.max() + 1, np.append(here, 0), from_[g], np.zeros(none)
            log = np.append(np.log(np.arange(1, far + 1)), np.inf)
            by, away = np.argsort(local[own], kind="stable"), np.empty((m, none), np.int64)
            ends = np.searchsorted(local[own][by], np.arange(m + 1))
            for j in range(m):
                spots = by[ends[j] : ends[j + 1]]
                at = np.repeat(np.append(spots, none), np.diff(spots, prepend=-1, append=none - 1))
                away[j] = np.where(at < stop, ahead[at] - here, far)
                if least is not None:
                    bound += np.maximum(weight[start + j] - log[away[j]], 0.0)
            if least is not None:
                held = np.flatnonzero(bound + 1e-6 >= least[g])
                if not len(held):
                    continue
                g, here, none, start, away = g[held], here[held], len(held), start[held], away[:, held]
            away, weights = away.T, weight[start[:, None] + np.arange(m)]
            by = np.argsort(away, axis=1, kind="stable")
            away, total, n = np.take_along_axis(away, by, 1), np.cumsum(np.take_along_axis(weights, by, 1), axis=1), np.arange(1, m + 1)
            there = away < far
            length, q = np.where(there, away + 1, 1), here[:, None] + away
            s = rounded(total - np.where(n > 1, n * np.log(length), 0.0), 9)
            s[~there | ((n > 1) & (s <= 0))] = -np.inf
            best_n = np.argmax(s, axis=1)
            s, q = s[np.arange(none), best_n], q[np.arange(none), best_n]
            by = np.lexsort((q, here, -s, g))
            by = by[np.diff(g[by], prepend=-1) != 0]
            score[g[by]], first[g[by]], last[g[by]] = s[by], here[by], q[by]
    return score, first, last


def _grouped(batches, rows: int = 200_000):
    """Batches of at least so many rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)
