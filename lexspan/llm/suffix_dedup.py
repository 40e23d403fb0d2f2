"""Substring de-duplication by prefix doubling over the positions that can recur: every byte that a repeated
string of ``size`` bytes covers is removed.

Doubling over all byte positions would write some 16 bytes for each byte of text and round. So positions are
first filed by the least k-gram of their window (``_windows``), which is their rank at that length: a k-gram
that stands once is unique and takes its positions out, and neighbouring positions whose whole string stands
twice are settled at once. What is left are the edges of repeated passages, in blocks of BLOCK neighbouring
positions. Their common bytes are ranked by doubling: each round pairs a block's rank for its first h bytes
with the name of the h bytes at offset h, Spark counts and sorts the pairs, unique pairs go, and the place in that order
is the rank for 2 h bytes, until all bytes that the block's windows share are ranked. The name of the second half is
computed where the text is, as its own rank may have gone with its positions. Blocks of one rank are told
apart by the bytes beside the common ones, and where these differ, position by position, by bytes too.

A removal thus rests on 64-bit names of k-grams and of stretches of bytes inside a group of one k-gram.

Texts are bytes of UTF-8; null and empty ones have none. Rows are documents of their own, also when
they are equal. Strings don't cross documents. An empty table gives an empty one; columns other than ``doc_id``
and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm._shared import arrow_map, forget, materialize
from lexspan.llm._windows import NO_ID, Names, batch_pieces, identified, mixed, packed, recurring, repeated, summed, unpacked

#: Bytes of the k-grams by which windows are filed.
GRAM = 40
#: Neighbouring windows that are ranked together first; rounds in which their rank's length is doubled.
BLOCK, DOUBLINGS = 16, 3
TABLE = mixed(np.arange(1, 257, dtype=np.uint64))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def byte_codes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in raws], dtype=np.int64)])
    return TABLE[np.frombuffer(b"".join(raws), np.uint8)], ends


def offsets(width: int) -> tuple[int, list[tuple[int, int]]]:
    """The length of the first rank, and for each doubling (offset, length) of the second half."""
    first = -(-width // (1 << DOUBLINGS))
    h, out = first, []
    while h < width:
        step = min(h, width - h)
        out.append((step, h))
        h += step
    return first, out


def edge_blocks(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The wanted classes in blocks of up to BLOCK neighbouring windows: names of the stretches that doubling
    pairs, and the few bytes left and right of what all windows of a block share.

    Blocks are cut at fixed distances before the k-gram of the class, so at equal places in equal
    passages; what the windows of a whole block share is named even where the class ends inside it.
    """
    width = size - BLOCK + 1
    h, more = offsets(width)

    def run(batches):
        for part, packs in batch_pieces(batches, 2):
            raws = unpacked(packs)
            codes, ends = byte_codes(raws)
            names, own = Names(codes), part.column(3).flatten()
            text = np.repeat(np.arange(len(raws)), np.diff(part.column(3).offsets.to_numpy()))
            gram, first, last, place = (own.field(k).to_numpy().astype(np.int64) for k in range(4))
            near, far = (place - last) // BLOCK, (place - first) // BLOCK
            counts = far - near + 1
            block = np.repeat(near, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            text, gram, first, last, place = (np.repeat(x, counts) for x in (text, gram, first, last, place))
            shared, of = place - block * BLOCK, pa.array(text)
            start, stop = np.maximum(first, shared - BLOCK + 1), np.minimum(last, shared)
            at = shared + ends[text]
            stretches = [names.of(at, h), *(names.of(at + step, n) for step, n in more)]
            joined, base = b"".join(raws), ends[text]
            left = [joined[a:b] for a, b in zip((start + base).tolist(), at.tolist(), strict=True)]
            right = [joined[a:b] for a, b in zip((at + width).tolist(), (stop + size + base).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(gram), *(pa.array(n.view(np.int64)) for n in stretches), pa.array(left, pa.binary()), pa.array(right, pa.binary()), part.column(0).take(of), part.column(1).take(of), pa.array(start.astype(np.int32))], columns)

    schema = ", ".join(["rank long", *(f"n{k} long" for k in range(1 + len(more))), "left binary, right binary, doc_id long, key long, start int"])
    columns = [c.split()[0] for c in schema.split(", ")]
    lists = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("gram", "first", "last", "place")).alias("spans"))
    return arrow_map(packed(rows).join(lists, ["doc_id", "key"]).select("doc_id", "key", "raw", "spans"), run, schema)


def doubled(blocks: DataFrame) -> DataFrame:
    """(doc_id, key, start, rank) of the blocks whose common bytes stand more than once, equal ranks for equal bytes."""
    rest = [c for c in blocks.columns if c.startswith("n")]
    rows, before = blocks.select("doc_id", "key", "start", "rank", *rest), None
    while rest:
        pair = ["rank", rest.pop(0)]
        ranks = repeated(rows, pair).sort(*pair).select(*pair, F.monotonically_increasing_id().alias("place"))
        ranks = materialize(ranks, "ranks")
        after = materialize(rows.join(ranks, pair).select("doc_id", "key", "start", F.col("place").alias("rank"), *rest), "doubled")
        forget(ranks, *([before] if before else []))
        rows = before = after
    return rows


def repeated_starts(blocks: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, key, first, last) of windows that stand in more than one place, and the written tables behind.

    Blocks whose common bytes have one rank and that have the same bytes beside these are settled together. Only
    where a rank has several kinds of block are the windows compared, once for each kind.
    """
    ranks = doubled(blocks)
    place, kind = ["doc_id", "key", "start"], ["rank", "left", "right"]
    left = materialize(blocks.select(*place, "left", "right").join(ranks, place), "blocks")
    forget(blocks, ranks)
    copies = materialize(left.groupBy(F.struct(*kind).alias("lexspan_key")).agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("rep")).select("lexspan_key.*", "n", "rep"), "kinds")
    size = F.octet_length("left") + F.octet_length("right") - (BLOCK - 2)
    last = (F.col("start") + size - 1).alias("last")
    settled = left.join(copies.where("n > 1").select(*kind), kind).select("doc_id", "key", F.col("start").alias("first"), last)
    single = copies.select(*kind, "rep.*")
    windows = single.join(repeated(single, ["rank"]), "rank").select("*", F.explode(F.sequence(F.lit(0), size - 1)).alias("k"))
    before, after = F.expr("substring(left, k + 1)").alias("before"), F.expr(f"substring(right, 1, {BLOCK - 1} - (octet_length(left) - k))").alias("after")
    own = windows.select("rank", before, after, "doc_id", "key", (F.col("start") + F.col("k")).cast("int").alias("first"))
    alone = own.join(repeated(own, ["rank", "before", "after"]), ["rank", "before", "after"]).select("doc_id", "key", "first", F.col("first").alias("last"))
    return settled.union(alone), [left, copies]


def remove_repeats(docs: DataFrame, size: int = 400, text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept): the removed runs of bytes, and the bytes left."""
    rows = identified(docs, text_col)
    found = recurring(rows, lambda: byte_codes, size, GRAM)
    kinds, each = summed(found)
    settled = found.join(each.where("n > 1").select("gram", "whole"), ["gram", "whole"]).select("doc_id", "key", "first", "last")
    edges = each.where("several").select("gram", "rep.*")
    starts, tables = repeated_starts(materialize(edge_blocks(rows, edges, size), "edges"))
    lists = materialize(settled.union(starts).groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    forget(found, kinds, *tables)

    def run(batches):
        for part, packs in batch_pieces(batches, 1):
            raws, runs, kept = unpacked(packs), [], []
            for raw, own in zip(raws, part.column(2).to_pylist(), strict=True):
                a, b = covered(own, size)
                runs.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
                kept.append(b"".join([raw[x:y] for x, y in zip([0, *b], [*a, len(raw)], strict=True)]))
            ids = part.column(0)
            ids = pa.array([None if i == NO_ID else i for i in ids.to_pylist()], pa.int64()) if NO_ID in ids.to_pylist() else ids
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(r) for r in raws], pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("removed", SPANS), T.StructField("kept", T.BinaryType())])
    return arrow_map(packed(rows).join(lists, ["doc_id", "key"], "left").select("doc_id", "raw", "spans"), run, schema)


def covered(spans: list[dict] | None, size: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of all windows from first to last."""
    if not spans:
        return [], []
    first = np.array([s["first"] for s in spans])
    stop = np.array([s["last"] for s in spans]) + size
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], first[1:] > stop[:-1]])
    return first[new].tolist(), stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)].tolist()


def digests(removed: DataFrame) -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
