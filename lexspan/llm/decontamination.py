"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Within k edits, a passage of n characters shares at least n + 1 - q - k q of its q-grams with the
text, all on diagonals at most 2 k apart. So the shared q-grams of a document and an item are counted in
overlapping bands of diagonals, 2 k wide each and k apart (any k + 1 adjacent diagonals lie in one);
bands with fewer are out, the others are verified by an alignment around the band. The edits of short
items are bounded by what the lemma can tell: (n - q) / q. Every
item is compared whole, so hits are whole items with up to ``rate`` of their length in edits.

Case and white space don't count. Null and empty texts have no hits, repeated rows the same ones, an empty table of either
kind gives an empty one; items shorter than q characters
after normalisation are looked for as they are, with no edit, inside words too: an item of one or two letters is found in nearly
every document, so such items should be taken out of a benchmark before. No columns but ids and texts are read, so that none can
clash. Benchmark sets over ``BLOCK_CHARS`` go through the documents in
blocks of items, so what is broadcast stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm._shared import arrow_map, pieces

#: Characters of benchmark items that are broadcast at once.
BLOCK_CHARS = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the bitmap that is asked before the index.
BITS = 22
#: Beyond every diagonal of a text.
FAR = 1 << 31
HIT = "doc_id long, item_id long, start int, end int, edits int, item_chars int"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit name of the q characters from each place on."""
    n = len(chars) - q + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        x = chars.astype(np.uint64)
        for k in range(q):
            out *= BASE
            out += x[k : k + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


@dataclass(frozen=True)
class Items:
    """Normalised items and an index of their q-grams."""

    ids: list[int]
    chars: list[np.ndarray]
    edits: list[int]
    q: int
    names: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # where each name's places begin
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray

    @staticmethod
    def build(rows: list[tuple[int, str]], q: int, rate: float) -> Items:
        kept = [(i, codes(t)) for i, raw in rows if (t := normal(raw))]
        # the lemma says something only while n + 1 - q - k q stays above 0
        edits = [max(0, min(int(rate * len(c)), (len(c) - q) // q)) for _, c in kept]
        each = [grams(c, q) for _, c in kept]
        names = np.concatenate(each) if each else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(each)), [len(g) for g in each])
        place = np.concatenate([np.arange(len(g)) for g in each]) if each else np.zeros(0, int)
        order = np.argsort(names, kind="stable")
        distinct, first = np.unique(names[order], return_index=True)
        seen = np.zeros(1 << BITS, bool)
        seen[(distinct >> np.uint64(64 - BITS)).astype(np.int64)] = True
        return Items([i for i, _ in kept], [c for _, c in kept], edits, q, distinct, np.append(first, len(names)), item[order], place[order], seen)

    def hits(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits): the best place of each item in each text that has it;
        places count characters of the normalised text."""
        rows = [codes(normal(t)) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
        chars = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
        names = grams(chars, self.q)
        at = np.flatnonzero(self.seen[(names >> np.uint64(64 - BITS)).astype(np.int64)]) if len(self.names) else np.zeros(0, int)
        slot = np.searchsorted(self.names, names[at]).clip(max=max(len(self.names) - 1, 0))
        good = self.names[slot] == names[at] if len(at) else np.zeros(0, bool)
        at, slot = at[good], slot[good]
        text = np.searchsorted(ends, at, "right") - 1
        inside = at + self.q <= ends[text + 1]
        at, slot, text = at[inside], slot[inside], text[inside]
        counts = self.first[slot + 1] - self.first[slot]
        listed = np.repeat(self.first[slot], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        text, at, item = np.repeat(text, counts), np.repeat(at, counts), self.item[listed]
        step = np.maximum(np.array(self.edits, np.int64), 1)
        # each band holds two steps of diagonals; any k + 1 adjacent diagonals lie in one of them
        band = (at - ends[text] - self.place[listed]) // step[item] + FAR
        key, counts = np.unique((text * len(self.ids) + item) * (4 * FAR) + band, return_counts=True)
        after = np.zeros(len(key), np.int64)
        if len(key) > 1:
            after[:-1] = np.where(np.diff(key) == 1, counts[1:], 0)
        before = np.zeros(len(key), np.int64)
        if len(key) > 1:
            before[1:] = np.where(np.diff(key) == 1, counts[:-1], 0)
        length = np.array([len(c) for c in self.chars], np.int64)
        need = length + 1 - self.q - np.array(self.edits, np.int64) * self.q
        item = key // (4 * FAR) % max(len(self.ids), 1)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for own, whole in ((key, counts + after), (key - 1, counts + before)):
            for j in np.flatnonzero(whole >= need[item]).tolist():
                pair, x = divmod(int(own[j]), 4 * FAR)
                t, i = divmod(pair, len(self.ids))
                if best.get((t, i), (0, 0, 1))[2] == 0:
                    continue
                k, w, b = self.edits[i], int(step[i]), x - FAR
                found = align(self.chars[i], rows[t], b * w - k, (b + 2) * w + k, k)
                if found and ((t, i) not in best or (found[2], found[0]) < (best[t, i][2], best[t, i][0])):
                    best[t, i] = found
        for (t, i), found in best.items():
            yield t, self.ids[i], *found
        for i, c in enumerate(self.chars):
            if len(c) < self.q:
                word = c.tobytes()
                for t, r in enumerate(rows):
                    raw, p = r.tobytes(), -1
                    while (p := raw.find(word, p + 1)) >= 0 and p % 4:
                        pass
                    if p >= 0:
                        yield t, self.ids[i], p // 4, p // 4 + len(c), 0


def align(item: np.ndarray, chars: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The best place of the whole item in the text with all of its path on diagonals low to high:
    (start, end, edits) if there are at most ``most`` edits. Ties go to the first end."""
    width = high - low + 1
    far = len(item) + most + width + 1
    steps = np.arange(width)
    column = steps + low  # text characters used before item character 0, on each diagonal
    cost = np.where((column >= 0) & (column <= len(chars)), 0, far)
    start = column.copy()
    for r, c in enumerate(item):
        column = column + 1  # on a diagonal, each item character moves one on in the text
        inside = (column >= 1) & (column <= len(chars))
        same = np.zeros(width, bool)
        same[inside] = chars[column[inside] - 1] == c
        step = cost + ~same
        step[~inside] = far
        # an item character without a text character comes from the next diagonal
        drop = np.append(cost[1:] + 1, far)
        new = np.where(step <= drop, step, drop)
        origin = np.where(step <= drop, start, np.append(start[1:], 0))
        # text characters without an item character: run along the row
        base = new - steps
        low_at = np.maximum.accumulate(np.where(base == np.minimum.accumulate(base), steps, 0))
        cost = base[low_at] + steps
        start = origin[low_at]
        cost[(column < 0) | (column > len(chars))] = far
        if cost.min() > most:
            return None
    b = int(cost.argmin())
    return (max(int(start[b]), 0), int(column[b]), int(cost[b])) if cost[b] <= most else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.08, text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, the place in the
    normalised text, edits, the item's length. Equal rows give equal hits; a null item id is no item."""
    clean = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    sized = clean.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(sized) // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    hits = None
    for b in range(blocks):
        rows = [(int(r[0]), r[1]) for r in clean.where(block == b).orderBy("item_id").toLocalIterator()]
        found = _scan(docs, Items.build(rows, q, rate), text_col)
        hits = found if hits is None else hits.union(found)
    return hits


def _scan(docs: DataFrame, items: Items, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        own = shared.value
        size = dict(zip(own.ids, (len(c) for c in own.chars), strict=True))
        for batch in batches:
            texts = batch.column(1)
            for a, b in pieces(texts, 1 << 20):
                ids = batch.column(0).slice(a, b - a)
                found = list(own.hits([t or "" for t in texts.slice(a, b - a).to_pylist()]))
                if found:
                    t, item, start, end, edits = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(t)), pa.array(item, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(edits, pa.int32()), pa.array([size[i] for i in item], pa.int32())], ["doc_id", "item_id", "start", "end", "edits", "item_chars"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col), run, HIT)
