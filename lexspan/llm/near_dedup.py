"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

A document is its set of word shingles; equal sets are one set of the join. Several independent trees branch the
sets by minwise tokens: a root is two positions of the signature and the tokens there, and a node of more than LEAF sets
branches again, each set into CHILDREN children by its tokens at positions that the node's name chooses, as long
as that cuts the node. A pair at 0.85 fails to meet at all roots in one case of 4 million, at 0.8 of 200,000,
and below a node in one of 13,000 for each level, in each of the 8 or 9 trees where it meets. Nodes with the same members are
compared once.

Nodes of up to LEAF sets are compared exhaustively on the full sets. A node that branching does not cut is a family
of like sets and loses no pair either: rounds of chance blocks of LEAF sets link what is close,
and then every set outside the node's largest component is compared with all sets of the node, in
blocks. Sets of one component need no comparison, so a family of near copies costs in proportion to its
size; only a large node of unlike sets with the same tokens costs the square. Nothing is capped.

A null or empty text has no set and links with nothing, ids may be null or repeated, an empty table gives an empty one, and no other
column is read, so that none can clash.

Links hold at 100 |A and B| >= percent |A or B|, exactly, on 64-bit names of all shingles. A node returns a spanning forest of its links,
which loses no component and never lists all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm._shared import arrow_map, connected_components, forget, materialize
from lexspan.llm._windows import Names, batch_pieces, mixed, packed, unpacked, word_codes

#: Positions of a signature, trees, sets of a node that is compared at once, rounds of chance blocks at most.
POSITIONS, TREES, LEAF, DEPTH = 96, 12, 800, 10
#: Rows of nodes that are broadcast at most; more are joined by their name.
FEW = 100_000
#: Children of a set in a node that branches; levels of branching below the roots at most.
CHILDREN, LEVELS = 5, 6
FACTORS = mixed(np.arange(1, POSITIONS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
SHIFTS = mixed(np.arange(1001, POSITIONS + 1001, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle names of each text: ``width`` words, or all words of a shorter text."""
    codes, ends = word_codes([r.lower() for r in raws])
    names = Names(codes)
    every = names.all(width) if len(codes) >= width else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(names.of(np.array([a]), b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of POSITIONS hash functions."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        y = x[k : k + 4096, None] * FACTORS + SHIFTS
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, y.min(axis=0))
    return out.view(np.int32)


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, one, two, sig): size, a 128-bit name and the signature of each set."""

    def run(batches):
        for part, raws in batch_pieces(batches, 1):
            sets = shingle_sets(raws, width)
            one = np.array([mixed(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            two = np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            sigs = np.concatenate([signature(s) for s in sets]) if sets else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * POSITIONS, pa.int32()), pa.array(sigs))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), lists], ["doc_id", "n", "one", "two", "sig"])

    return arrow_map(rows, run, "doc_id long, n long, one long, two long, sig array<int>")


def leaves(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, id, n): members of nodes of two to LEAF sets, and of larger ones that branching doesn't cut;
    ``sets`` has (id, sig)."""
    places = np.random.default_rng(3).permutation(POSITIONS)[: 2 * TREES].reshape(-1, 2).tolist()
    roots = F.array(*[F.xxhash64(F.lit(tree), F.lit(i), F.col("sig")[i], F.lit(j), F.col("sig")[j]) for tree, (i, j) in enumerate(places)])
    found = members(sets.select("id", F.lit(0).cast("long").alias("parent"), F.explode(roots).alias("node")))
    small, stuck = found.where(F.col("n") <= LEAF).select("node", "id", "n"), None
    for level in range(LEVELS):
        large = found.where(F.col("n") > LEAF)
        if large.isEmpty():
            break
        place = lambda k: F.pmod(F.xxhash64("node", k), F.lit(POSITIONS)).cast("int")
        child = F.transform(F.sequence(F.lit(1), F.lit(CHILDREN)), lambda k: F.xxhash64("node", k, F.element_at("sig", place(k) + 1)))
        below = members(large.select("id", "node", F.col("n").alias("from")).join(sets, "id").select("id", F.col("node").alias("parent"), F.explode(F.array_distinct(child)).alias("node")))
        # a node is cut if no child holds most of it
        most = below.groupBy(F.col("parent").alias("node")).agg(F.max("n").alias("most"))
        whole = large.groupBy("node").agg(F.max("n").alias("size"), F.min("parent").alias("parent")).join(most, "node", "left")
        keeps = whole.where((F.col("most") > 0.5 * F.col("size")) if level + 1 < LEVELS else F.lit(True)).select("node")
        rest = large.join(keeps, "node", "left_semi").select("node", "id", "n")
        stuck = rest if stuck is None else stuck.union(rest)
        found = below.join(keeps.withColumnRenamed("node", "parent"), "parent", "left_anti")
        small = small.union(found.where(F.col("n") <= LEAF).select("node", "id", "n"))
    return small, small.where("false") if stuck is None else materialize(stuck, "stuck")


def members(level: DataFrame) -> DataFrame:
    """(parent, node, id, n): the members of all nodes of two sets or more, nodes with the same members of one parent once."""
    level = materialize(level, "level")
    nodes = level.groupBy("parent", "node").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")).where("n > 1")
    once = nodes.groupBy("members", "n").agg(F.min(F.struct("parent", "node")).alias("s")).select("s.node", "n")
    found = materialize(level.join(once, "node").select("parent", "node", "id", "n"), "nodes")
    forget(level)
    return found


def large_links(texts: DataFrame, inside: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links of nodes of more than LEAF sets, as ``leaves`` gives them; every pair that isn't in one component yet is compared.
    ``texts`` has (id, raw) of their members."""
    listed = lambda members: texts.join(members.groupBy("id").agg(F.collect_list("node").alias("nodes")), "id")
    blocks = lambda n: F.ceil(n / LEAF).cast("int")
    links, before = None, None
    own = inside.withColumn("part", F.col("id"))
    for turn in range(DEPTH + 1):
        counts = own.groupBy("node", "part").agg(F.count("*").alias("k"))
        top = materialize(counts.groupBy("node").agg(F.max(F.struct("k", "part")).alias("most"), F.sum("k").alias("n")).select("node", F.col("most.part").alias("main"), F.col("most.k").alias("k"), (F.col("n") - F.col("most.k")).alias("rest")), "parts")
        rest = top.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
        if turn == DEPTH or rest == 0 or (before is not None and 2 * rest > before):
            break
        before = rest
        block = F.xxhash64("node", F.lit(turn), F.pmod(F.xxhash64("id", F.lit(turn)), blocks(F.col("n"))))
        found = compared(listed(inside.select(block.alias("node"), "id")), width, percent)
        links = materialize(found if links is None else links.union(found), "linked")
        parts = connected_components(links, "a", "b").toDF("id", "part")
        own = materialize(inside.join(parts, "id", "left").select("node", "id", "n", F.coalesce("part", "id").alias("part")), "own")
    # what is outside the largest component of its node, against all of the node
    mains, rests = blocks(2 * F.col("k")), blocks(2 * F.col("rest"))
    mine = lambda parts: F.pmod(F.xxhash64("id", F.lit(DEPTH)), parts).cast("int")
    upto = lambda parts, name: F.transform(F.sequence(F.lit(0), parts - 1), name)
    key = lambda kind, i, j: F.xxhash64("node", F.lit(kind), i, j)
    of_main = upto(rests, lambda i: key(0, i, mine(mains)))
    of_rest = F.concat(upto(mains, lambda j: key(0, mine(rests), j)), upto(rests, lambda i: key(1, F.least(i, mine(rests)), F.greatest(i, mine(rests)))))
    uneven = top.where("rest > 0")
    few = uneven.count() <= FEW
    dealt = own.drop("n").join(F.broadcast(uneven) if few else uneven, "node").select(F.explode(F.when(F.col("part") == F.col("main"), of_main).otherwise(of_rest)).alias("node"), "id")
    last = compared(listed(dealt), width, percent)
    return last if links is None else links.union(last)


def compared(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): exact links of all nodes, as a spanning forest of each node; ``texts`` has (id, raw, nodes)."""

    def dealt(batches):
        for part, packs in batch_pieces(batches, 1):
            nodes, ids, sets = [], [], []
            for doc, own, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), shingle_sets(unpacked(packs), width), strict=True):
                raw = s.tobytes()
                for node in own:
                    nodes.append(node), ids.append(doc), sets.append(raw)
            for k in range(0, len(nodes), 256):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 256], pa.int64()), pa.array(ids[k : k + 256], pa.int64()), pa.array(sets[k : k + 256], pa.binary())], ["node", "id", "members"])

    def linked(batches):
        for ids, sets in groups(batches):
            pairs = forest(ids, sets, percent)
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    shipped = arrow_map(texts.select("id", "raw", "nodes"), dealt, "node long, id long, members binary").repartition("node").sortWithinPartitions("node")
    return arrow_map(shipped, linked, "a long, b long")


def groups(batches) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Members of one node after another, from rows that are sorted by node."""
    now, ids, sets = None, [], []
    for batch in batches:
        for node, doc, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != now:
                if len(ids) > 1:
                    yield ids, sets
                now, ids, sets = node, [], []
            ids.append(doc), sets.append(np.frombuffer(raw, np.uint64))
    if len(ids) > 1:
        yield ids, sets


def forest(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Exact links between sets, only those that connect what wasn't connected yet."""
    root = list(range(len(ids)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets], np.int64)
    if len(ids) > 8:
        # common members of all pairs: a product of 0/1 rows over shingles that stand in two sets or more
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        names, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
        keep = np.cumsum(counts > 1) - 1
        good = counts[at] > 1
        owner, at = owner[good], keep[at[good]]
        common = np.zeros((len(ids), len(ids)), np.float32)
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        for low in range(0, int(keep[-1]) + 1 if len(keep) else 0, 4096):
            a, b = np.searchsorted(at, [low, low + 4096])
            block = np.zeros((len(ids), 4096), np.float32)
            block[owner[a:b], at[a:b] - low] = 1
            common += block @ block.T
        both = common.astype(np.int64)
        near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        pairs = np.argwhere(np.triu(near, 1)).tolist()
    else:
        pairs = [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids))]
    out = []
    for i, j in pairs:
        x, y = top(i), top(j)
        if x == y:
            continue
        if len(ids) <= 8:
            if 100 * min(sizes[i], sizes[j]) < percent * max(sizes[i], sizes[j]):
                continue
            both_ = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both_ < percent * (sizes[i] + sizes[j] - both_):
                continue
        root[x] = y
        out.append((ids[i], ids[j]))
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85, text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row.

    Rows of one id are one node with the links of all of them; a row without an id links with
    nothing, has no component and is kept. Null and empty texts have no shingles and no links.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    named = materialize(signatures(rows, width), "signatures")
    some = named.where("n > 0 and doc_id is not null")
    sets = materialize(some.groupBy("one", "two").agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig")), "sets")
    copies = some.join(sets.select("one", "two", "id"), ["one", "two"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    small, large = leaves(sets.select("id", "sig"))
    # one join moves the texts of all members; as these are a share of all documents, it never broadcasts them
    both = small.select("id", "node").union(large.select("id", F.lit(None).cast("long")))
    lists = both.groupBy("id").agg(F.collect_list("node").alias("nodes"), F.max(F.col("node").isNull()).alias("large"))
    moved = packed(rows.select("doc_id", F.lit(0).cast("long").alias("key"), "raw")).join(lists.hint("merge"), F.col("doc_id") == F.col("id"))
    texts = materialize(moved.select("id", "raw", "nodes", "large"), "texts")
    links = materialize(compared(texts.where("size(nodes) > 0"), width, percent), "small-links")
    if not large.isEmpty():
        links = links.union(large_links(texts.where("large").select("id", "raw"), large, width, percent))
    parts = connected_components(copies.union(links), "a", "b")
    forget(sets, texts)
    found = named.select("doc_id", F.col("n").alias("n_shingles")).join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
