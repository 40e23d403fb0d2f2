"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Vectors are scaled to length 1 and projected on PROJECTIONS random lines. At a cosine of the
threshold the difference of two projections is normal with a known spread, so a window of WIDE
spreads around a query holds its neighbours with a known chance, and the count of windows that a
neighbour collides in is binomial: the least count asked for is the largest that keeps the recall
over RECALL. The rows are sorted by AXES of the projections into slabs of about SLAB rows, and each slab is
compared with itself and with every later one that its windows reach, two slabs at a time: each query counts its
collisions on all lines with the rows in its window, and pairs with enough
are verified by cosine in double precision. A pair in the windows of several axes belongs to the
first. A task thus holds two slabs, whatever the table's size, and of the pairs that it verifies only the number for each
vector and a spanning forest; what is compared in all is a fixed share of all pairs, so the work
grows with the square of the rows.

Equal vectors are one vector with a weight. Vectors that are null, zero or hold null or non-finite
components link with nothing, vectors of different lengths don't link; rows without an id have no
links and no component and are kept. Repeated rows of one id are one vector. An empty table gives an empty one; no
other column is read, so that none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm._shared import arrow_map, connected_components, materialize

PROJECTIONS, AXES, WIDE, RECALL = 12, 2, 2.0, 0.995
#: Rows of a slab, a tenth more at most; queries of a block.
SLAB, BLOCK = 4096, 64


def window(least: float) -> float:
    """Half the width of a query's window."""
    return WIDE * math.sqrt(max(2 - 2 * least, 1e-6))


def least_count() -> int:
    """The largest count that a pair at the threshold reaches with a chance of RECALL."""
    q = math.erf(WIDE / math.sqrt(2))
    tail = 0.0
    for c in range(PROJECTIONS, 0, -1):
        tail += math.comb(PROJECTIONS, c) * q**c * (1 - q) ** (PROJECTIONS - c)
        if tail >= RECALL:
            return c
    return 1


def lines(width: int) -> np.ndarray:
    """The projection lines for vectors of one length."""
    return np.random.default_rng([11, width]).normal(size=(width, PROJECTIONS))


def projected(rows: DataFrame) -> DataFrame:
    """(id, n, v, p): vectors and their projections, as bytes of doubles."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            raws, shots = [], []
            for v in batch.column(2).to_pylist():
                x = np.array(v, np.float64)
                x = x / np.abs(x).max()
                x /= np.linalg.norm(x)
                if len(x) not in known:
                    known[len(x)] = lines(len(x))
                raws.append(x.tobytes()), shots.append((x @ known[len(x)]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raws, pa.binary()), pa.array(shots, pa.list_(pa.float64()))], ["id", "n", "v", "p"])

    return arrow_map(rows.select("id", "n", "embedding"), run, "id long, n long, v binary, p array<double>")


def slabs(rows: DataFrame, cuts: list[np.ndarray], wide: float) -> DataFrame:
    """Each row with its own slab, as a query of the slabs after it that its window reaches, and as a row that the windows
    of slabs before it reach; ``pair`` names the two slabs and the axis."""

    def run(batches):
        for batch in batches:
            p = np.array(batch.column(3).to_pylist(), np.float64).reshape(-1, PROJECTIONS)
            for axis, cut in enumerate(cuts):
                own = np.searchsorted(cut, p[:, axis], "right")
                first = np.searchsorted(cut, p[:, axis] - wide, "left")
                last = np.searchsorted(cut, p[:, axis] + wide, "right")
                counts = last - first + 1
                at = np.repeat(np.arange(len(p)), counts)
                other = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                query = other >= own[at]
                low, high = np.minimum(other, own[at]), np.maximum(other, own[at])
                pair = (low * (len(cut) + 1) + high) * AXES + axis
                of = pa.array(at)
                for k in range(0, len(at), 2000):
                    part = of.slice(k, 2000)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[k : k + 2000], pa.int64()), pa.array(low[k : k + 2000] == high[k : k + 2000]), pa.array(query[k : k + 2000]), *(batch.column(c).take(part) for c in range(4))], ["pair", "same", "query", "id", "n", "v", "p"])

    return arrow_map(rows, run, "pair long, same boolean, query boolean, id long, n long, v binary, p array<double>")


def linked(found: DataFrame, least: float) -> DataFrame:
    """(id, other, n): other = null, how many vectors id links to in one slab; else a vector of the
    same component."""
    wide, enough = window(least), least_count()

    def run(batches):
        for axis, same, query, ids, weights, vectors, shots in groups(batches):
            count, forest = np.zeros(len(ids)), Forest(len(ids))
            for a, b in pairs(axis, same, query, vectors, shots, wide, enough, least):
                count += np.bincount(a, weights[b], len(ids)) + np.bincount(b, weights[a], len(ids))
                forest.join(a, b)
            label = forest.label
            own, tied = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[own], ids[tied]])), pa.array([None] * len(own) + ids[label[tied]].tolist(), pa.int64()), pa.array(np.concatenate([count[own], 0 * tied]).astype(np.int64))], ["id", "other", "n"])

    return arrow_map(found.repartition("pair").sortWithinPartitions("pair"), run, "id long, other long, n long")


class Forest:
    """Components of the rows of a group, each labelled by one of its rows."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        links = np.unique(np.stack([x, y], 1)[x != y], axis=0)
        if not len(links):
            return
        root: dict[int, int] = {}

        def top(k: int) -> int:
            while (up := root.get(k, k)) != k:
                root[k] = root.get(up, up)
                k = up
            return k

        for u, v in links.tolist():
            u, v = top(u), top(v)
            if u != v:
                root[max(u, v)] = min(u, v)
        to = np.arange(len(self.label))
        to[list(root)] = [top(k) for k in list(root)]
        self.label = to[self.label]


def groups(batches):
    """(axis, one slab or two, is query, ids, weights, vectors, projections) of one pair of slabs after another."""
    now, held = None, []

    def made():
        same, query, ids, n, v, p = (list(x) for x in zip(*held, strict=True))
        return now % AXES, same[0], np.array(query), np.array(ids, np.int64), np.array(n, np.float64), v, np.array(p, np.float64)

    for batch in batches:
        for pair, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pair != now:
                if held:
                    yield made()
                now, held = pair, []
            held.append(row)
    if held:
        yield made()


def pairs(axis: int, same: bool, query: np.ndarray, raw: list[bytes], p: np.ndarray, wide: float, enough: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of verified pairs, some queries at a time; each query looks at the rows after it in the order of the axis, those
    of its own slab or of the other one."""
    size = np.array([len(r) for r in raw])
    order = np.lexsort((p[:, axis], size))  # vectors of one length stand together
    for width in np.unique(size):
        own = order[size[order] == width]
        x = np.frombuffer(b"".join([raw[i] for i in own]), np.float64).reshape(len(own), -1)
        q, on, asking = p[own].astype(np.float32), p[own, axis], query[own]
        asks = np.flatnonzero(asking)
        upto = np.searchsorted(on, on + wide, "right")
        for k in range(0, len(asks), BLOCK):
            rows = asks[k : k + BLOCK]
            low, high = rows[0], upto[rows].max()
            others = np.arange(low, high)
            count = np.zeros((len(rows), len(others)), np.int8)
            good = (others[None, :] > rows[:, None]) & (others[None, :] < upto[rows][:, None]) & (same | ~asking[others][None, :])
            for m in range(PROJECTIONS):
                hit = np.abs(q[rows, m][:, None] - q[low:high, m][None, :]) <= np.float32(wide)
                count += hit
                if m < axis:
                    good &= ~hit
            i, j = np.nonzero((count >= enough) & good)
            i, j = rows[i], others[j]
            for c in range(0, len(i), 20_000):
                a, b = i[c : c + 20_000], j[c : c + 20_000]
                sure = np.einsum("ij,ij->i", x[a], x[b]) >= least
                if sure.any():
                    yield own[a[sure]], own[b[sure]]


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    v = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + 0.0).alias("embedding"))
    rows = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b"))))
    some = rows.where(F.col("key").isNotNull())
    distinct = some.select("vec_id", "key").distinct().groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    values = some.groupBy("key").agg(F.any_value("embedding").alias("embedding"))
    numbered = distinct.join(values, "key").select(F.xxhash64("key").alias("id"), "first", "n", "key", "embedding")
    numbered = materialize(numbered, "vectors")
    made = materialize(projected(numbered), "projected")
    parts = max(1, -(-made.count() // SLAB))
    at = [k / parts for k in range(1, parts)]
    cuts = [np.array(made.select(F.col("p")[a].alias("x")).approxQuantile("x", at, 0.1 / parts) if at else [], np.float64) for a in range(AXES)]
    links = materialize(linked(slabs(made, cuts, window(least)), least), "vector-links")
    counts = links.where("other is null").groupBy("id").agg(F.sum("n").alias("more"))
    names = numbered.select("id", "key", "first", "n")
    own = some.select("vec_id", "key").distinct().join(names, "key")
    to_first = lambda c: names.select(F.col("id").alias(c), F.col("first").alias(f"{c}_first"))
    ties = links.where("other is not null").join(to_first("id"), "id").join(to_first("other"), "other").select(F.col("id_first").alias("a"), F.col("other_first").alias("b"))
    components = connected_components(ties.union(own.select(F.col("vec_id").alias("a"), F.col("first").alias("b"))), "a", "b").withColumnsRenamed({"node": "vec_id", "component": "component_id"})
    told = own.join(counts, "id", "left").select("vec_id", "key", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "key").join(told, ["vec_id", "key"], "left").join(components, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
