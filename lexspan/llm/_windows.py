"""Windows of a fixed length that recur: rolling names, and classes of windows by their least k-gram.

Every window of ``size`` elements is filed under the least-named k-gram inside it (the first, on a
tie), which depends on nothing but the window. Neighbouring windows with the same k-gram form a
class, so a text has about 2 / (size - k) classes an element. Equal windows have equal k-grams at
equal places: a class whose k-gram stands nowhere else has no window that recurs, and classes with
equal whole strings recur in all their windows. Only the rest, the classes at the edges of
repeated passages, are looked at window by window. Nothing is sampled; all windows are covered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm._shared import arrow_map, forget, materialize, pieces

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Window starts that are worked on at once; with the halo below 2^20.
SLICE = 1 << 16
#: Stands for a null id inside the operators.
NO_ID = -(1 << 63)

Codes = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n modulo 2^64."""
    out = np.ones(n + 1, np.uint64)
    have, step = 1, base
    while have <= n:
        more = min(have, n + 1 - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        have, step = have * 2, step * step % (1 << 64)
    return out


class Names:
    """64-bit names of all strings of a code sequence, from prefix sums."""

    forward = powers(BASE, 1 << 16)
    back = powers(INVERSE, 1 << 16)

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        if n >= len(Names.forward):
            Names.forward, Names.back = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * Names.forward[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Names of the strings at ``start``; names of different lengths differ."""
        x = (self.sums[start + size] - self.sums[start]) * Names.back[start]
        return mixed(x + np.asarray(size).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[size:] - self.sums[:-size]) * Names.back[:n])


class Words:
    """The words of a list of texts (bytes): runs of anything but the six ASCII white-space characters.

    ``codes`` has a 64-bit name for each word, ``ends`` where each text's words end; ``plain`` is all words in
    order, each followed by a space, and word i starts there at ``spot[i]``.
    """

    def __init__(self, raws: list[bytes]) -> None:
        joined = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
        blank = WHITE[joined]
        after = np.concatenate([[True], blank[:-1]])
        self.start = np.flatnonzero(~blank & after)
        stop = np.flatnonzero(blank & ~after)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        self.ends = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(sizes + 1)]))
        self.codes = Names(LETTERS[joined]).of(self.start, stop - self.start)
        kept = ~(blank & after)
        self.plain = np.where(blank, np.uint8(32), joined)[kept].tobytes()
        self.spot = np.concatenate([[0], np.cumsum(stop - self.start + 1)])

    def said(self, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """The words from each start to before its stop, joined by spaces; no range is empty."""
        plain = self.plain
        return [plain[a : b - 1] for a, b in zip(self.spot[start].tolist(), self.spot[stop].tolist(), strict=True)]


def word_codes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = Words(raws)
    return words.codes, words.ends


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: Which bytes are white space; a number for each byte.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have, step = values, 1
    while step * 2 <= width:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    rest = width - step
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def classes(codes: np.ndarray, ends: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first, last, place, gram, whole): the classes of all texts, windows and the place of the k-gram
    counted from their text's start.

    ``gram`` names the k-gram and ``whole`` the string from the first window's start to the last one's end.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, max(len(codes) - size + 1, 0), SLICE):
        part = codes[low : low + SLICE + size - 1]
        names = Names(part)
        grams = names.all(k)
        place = np.arange(len(grams), dtype=np.uint64)
        low20 = np.uint64((1 << 20) - 1)
        at = (least((grams & ~low20) | place, size - k + 1) & low20).astype(np.int64)
        starts = np.arange(low, low + len(at))
        a, b = np.searchsorted(ends, [low, low + len(at) - 1], "right") - 1
        text = np.repeat(np.arange(a, b + 1), np.diff(np.clip(ends[a : b + 2], low, low + len(at))))
        keep = starts + size <= ends[text + 1]
        starts, text, at = starts[keep], text[keep], at[keep]
        if not len(starts):
            continue
        cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(at) != 0) | (np.diff(text) != 0))
        first, last = starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)]
        rows = np.concatenate([[0], cut + 1])
        found.append((text[rows], first - ends[text[rows]], last - ends[text[rows]], at[rows] + low - ends[text[rows]], grams[at[rows]].view(np.int64), names.of(first - low, last - first + size).view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def identified(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc_id, key, raw): the id (null: NO_ID), a name of the text that tells rows of one id apart,
    the text's bytes (null: none)."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(raw).alias("key"), raw.alias("raw"))


def packed(rows: DataFrame) -> DataFrame:
    """(doc_id, key, raw) with each text compressed: for joins that have to move the texts."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            for a, b in pieces(batch.column(2)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pack(r) for r in part.column(2).to_pylist()], pa.binary())], ["doc_id", "key", "raw"])

    return arrow_map(rows, run, "doc_id long, key long, raw binary")


def unpacked(packs: list[bytes]) -> list[bytes]:
    return [zstandard.decompress(p) for p in packs]


def batch_pieces(batches, column: int, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for a, b in pieces(batch.column(column), most):
            part = batch.slice(a, b - a)
            yield part, part.column(column).to_pylist()


def recurring(rows: DataFrame, codes: Callable[[], Codes], size: int, k: int) -> DataFrame:
    """Classes whose k-gram stands in more than one: (gram, whole, doc_id, key, first, last, place).

    The classes of all texts are made twice, once to count the k-grams and once to keep those that
    recur, as that costs less disk than writing the many that don't.
    """

    def run(batches):
        to_codes = codes()
        for part, raws in batch_pieces(batches, 2):
            text, first, last, place, gram, whole = classes(*to_codes(raws), size, k)
            of = pa.array(text)
            spot = first << 32 | (last - first) << 16 | (place - first)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(whole), part.column(0).take(of), part.column(1).take(of), pa.array(spot)], ["gram", "whole", "doc_id", "key", "spot"])

    assert size < 1 << 16, "a class has fewer windows than a window has elements, and places are packed by that"
    every = arrow_map(rows, run, "gram long, whole long, doc_id long, key long, spot long")
    first = F.shiftright("spot", 32)
    last, place = first + F.shiftright("spot", 16).bitwiseAND(0xFFFF), first + F.col("spot").bitwiseAND(0xFFFF)
    found = every.join(repeated(every, ["gram"]), "gram")
    return materialize(found.select("gram", "whole", "doc_id", "key", first.cast("int").alias("first"), last.cast("int").alias("last"), place.cast("int").alias("place")), "recurring")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys of more than one row. They are counted as one struct, so that joining them back deals
    the rows anew and Spark can split a key that many rows have."""
    return rows.groupBy(F.struct(*key).alias("lexspan_key")).count().where("count > 1").select("lexspan_key.*")


def summed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A written table, and from it each distinct class: (gram, whole, n, rep, several): its number, its
    first place, whether its k-gram has other classes too."""
    one = found.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "first", "last", "place")).alias("rep"))
    one = materialize(one, "classes")
    several = one.groupBy("gram").agg((F.count("*") > 1).alias("several"))
    return one, one.join(several, "gram")
