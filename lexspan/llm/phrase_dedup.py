"""Substring de-duplication by repeated-phrase automata: every word that a window of ``size`` words
covers is removed if the window's words also start earlier.

Passages are confirmed first: texts are cut into classes of neighbouring windows with the same least k-gram
(``_windows``), and what recurs, a whole class or single windows that differing classes share, becomes a
phrase with its first place. Only names are compared there, and only the first place of a phrase is kept.

The phrases are dealt to shards by their k-gram. Each shard compiles one Aho-Corasick automaton over words,
each word one letter, and all class texts with a k-gram of the shard stream through it: a text that shares
no k-gram with a shard can hold none of its phrases. Texts that are equal as a whole stream through once. The
automaton locates every occurrence, word by word; those after the phrase's first place are removed.
A shard with more than MOST_WORDS words of phrases is cut into several automata, one with more than MOST_TEXTS
texts into several streams; every stream passes every automaton of its shard.

Words are runs of anything but the six ASCII white-space characters. Documents are ordered by id
(null first), rows of one id by a hash of their text; equal rows of one id are one document. Null and empty texts
have no words; an empty table gives an empty one. Columns other than ``doc_id`` and the text are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm._shared import arrow_map, forget, materialize
from lexspan.llm._windows import NO_ID, Names, Words, batch_pieces, identified, packed, recurring, summed, unpacked, word_codes

#: Words of the k-grams by which windows are filed.
GRAM = 4
#: Words of phrases that a shard has on average (its automaton then fits a processor cache), that one automaton has at
#: most; texts of one stream.
SHARD_WORDS, MOST_WORDS, MOST_TEXTS = 16_000, 1_000_000, 200_000
PLACE = "doc_id", "key", "first"
HIT = "array<struct<at:int,n:int,doc_id:bigint,key:bigint,first:int>>"
OUT = "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept string"


def passages(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The wanted classes with their words, and the names of all windows of those that share their k-gram."""

    def run(batches):
        for part, packs in batch_pieces(batches, 2):
            cut = Words(unpacked(packs))
            names = Names(cut.codes).all(size)
            lists = part.column(3)
            own = lists.flatten()
            text = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            gram, whole, first, last, several, repeats = (own.field(k) for k in range(6))
            start = first.to_numpy() + cut.ends[text]
            stop = last.to_numpy() + cut.ends[text] + size
            words = cut.said(start, stop)
            counts = np.where(several.to_numpy(zero_copy_only=False), stop - start - size + 1, 0)
            upto = np.concatenate([[0], np.cumsum(counts)])
            ranks = names[np.repeat(start - upto[:-1], counts) + np.arange(upto[-1])].view(np.int64)
            of = pa.array(text)
            yield pa.RecordBatch.from_arrays([gram, whole, part.column(0).take(of), part.column(1).take(of), first, pa.array(words, pa.binary()).cast(pa.string()), repeats, pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ranks))], ["gram", "whole", "doc_id", "key", "first", "words", "repeats", "ranks"])

    lists = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("gram", "whole", "first", "last", "several", "repeats")).alias("spans"))
    return arrow_map(packed(rows).join(lists, ["doc_id", "key"]).select("doc_id", "key", "raw", "spans"), run, "gram long, whole long, doc_id long, key long, first int, words string, repeats boolean, ranks array<long>")


def confirmed(said: DataFrame) -> DataFrame:
    """The classes with ``ks``, the places inside of those windows that other classes of the k-gram share and that
    start here first."""
    windows = said.select("gram", "doc_id", "key", "first", F.posexplode("ranks").alias("k", "rank"))
    first = F.min(F.struct("doc_id", "key", (F.col("first") + F.col("k")).alias("start"), "k")).alias("src")
    recur = windows.groupBy("gram", "rank").agg(F.count("*").alias("n"), first).where("n > 1")
    lists = recur.groupBy("gram", "src.doc_id", "src.key", (F.col("src.start") - F.col("src.k")).alias("first")).agg(F.collect_list("src.k").alias("ks"))
    return said.drop("ranks").join(lists, ["gram", *PLACE], "left")


def sharded(phrases: DataFrame, size: int) -> DataFrame:
    """(shard, part, stream, supplies, streams, ...): each class where its phrases are compiled and where its
    text passes; one row for both unless the shard is cut."""
    supplies = F.col("repeats") | F.col("ks").isNotNull()
    weight = F.when(F.col("repeats"), F.size(F.split("words", " "))).otherwise(0) + F.when(F.col("ks").isNotNull(), size * F.size("ks")).otherwise(0)
    # every word of a class that supplies phrases gets a letter, and letters are bounded
    letters = F.when(supplies, F.size(F.split("words", " "))).otherwise(0)
    rows = phrases.withColumns({"supplies": supplies, "weight": weight.cast("long"), "letters": letters.cast("long")})
    shards = max(1, -(-int(rows.agg(F.sum("weight")).first()[0] or 0) // SHARD_WORDS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
    sizes = rows.groupBy("shard").agg(F.ceil(F.greatest(F.sum("weight"), F.sum("letters")) / MOST_WORDS).cast("int").alias("parts"), F.ceil(F.count("*") / MOST_TEXTS).cast("int").alias("flows"))
    rows = rows.join(sizes.where("parts > 1 or flows > 1"), "shard", "left")
    mine = lambda n: F.pmod(F.xxhash64("whole"), F.col(n)).cast("int")
    place = lambda part, stream, supplies, streams: F.struct(part.alias("part"), stream.alias("stream"), supplies.alias("supplies"), streams.alias("streams"))
    upto = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    given = F.when(F.col("supplies"), upto("flows", lambda s: place(mine("parts"), s, yes, no))).otherwise(F.array().cast("array<struct<part:int,stream:int,supplies:boolean,streams:boolean>>"))
    taken = upto("parts", lambda p: place(p, mine("flows"), no, yes))
    where = F.when(F.col("parts").isNull(), F.array(place(zero, zero, F.col("supplies"), yes))).otherwise(F.concat(given, taken))
    out = rows.withColumn("to", F.explode(where))
    return out.select("shard", "to.part", "to.stream", "to.supplies", "to.streams", "gram", "whole", *PLACE, "words", "repeats", "ks")


def occurrences(shards: DataFrame, size: int) -> DataFrame:
    """(gram, whole, hits): where in the class text ``n`` words are a phrase, and the phrase's first place."""

    def run(batches):
        gc.disable()  # there are no cycles here, and looking for them among many live phrases takes long
        try:
            yield from found(batches)
        finally:
            gc.enable()

    def found(batches):
        shard, phrases, waiting, automaton = None, Phrases(size), [], None
        for batch in batches:
            out: list[tuple] = []
            for *now, supplies, streams, gram, whole, doc, key, first, words, repeats, ks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != shard:
                    out += passed(waiting, automaton or phrases.compiled())
                    shard, phrases, waiting, automaton = now, Phrases(size), [], None
                cut = words.split(" ")
                text = phrases.add(cut, (doc, key, first), repeats, ks or ()) if supplies else phrases.text(cut)
                if streams:
                    waiting.append((gram, whole, text))
                # a shard's phrases come first: from its first other row on, texts pass as they come
                if not supplies:
                    automaton = automaton or phrases.compiled()
                    out += passed(waiting, automaton)
                    waiting = []
            if out:
                yield told(out)
        out = list(passed(waiting, automaton or phrases.compiled()))
        for k in range(0, len(out), 1000):
            yield told(out[k : k + 1000])

    def told(out: list[tuple]) -> pa.RecordBatch:
        hit = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("first", pa.int32())])
        upto = np.concatenate([[0], np.cumsum([len(hits) for *_, hits in out])])
        columns = list(zip(*chain.from_iterable(hits for *_, hits in out), strict=True))
        flat = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, hit, strict=True)], fields=list(hit))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat)], ["gram", "whole", "hits"])

    by = ["shard", "part", "stream"]
    dealt = shards.repartition(*by).sortWithinPartitions(*by, F.desc("supplies"))
    return arrow_map(dealt, run, f"gram long, whole long, hits {HIT}")


class Letters(dict):
    """Gives every new word the next letter."""

    def __missing__(self, word: str) -> str:
        self[word] = found = letter(len(self) + 1)
        return found


class Phrases:
    """The phrases of one shard, as texts in which every word is one letter."""

    def __init__(self, size: int) -> None:
        self.size, self.letters, self.first = size, Letters(), {}

    def add(self, words: list[str], place: tuple[int, int, int], whole: bool, ks: list[int]) -> str:
        """A class's words from ``place`` on are phrases: all of them, and the windows that start at ``ks``."""
        text = "".join(map(self.letters.__getitem__, words))
        doc, key, first = place
        for t, at in [*([(text, first)] if whole else []), *((text[k : k + self.size], first + k) for k in ks)]:
            if t not in self.first or (doc, key, at) < self.first[t]:
                self.first[t] = (doc, key, at)
        return text

    def text(self, words: list[str]) -> str:
        """Words that aren't in any phrase are no letter of one."""
        get = self.letters.get
        return "".join([get(w, "\0") for w in words])

    def compiled(self) -> Located:
        return Located(self.first)


class Located:
    """An automaton of phrases; finds all of them in a text."""

    def __init__(self, first: dict[str, tuple[int, int, int]]) -> None:
        self.automaton, self.any = ahocorasick.Automaton(), bool(first)
        for text, (doc, key, at) in first.items():
            self.automaton.add_word(text, (len(text), doc, key, at + len(text) - 1))
        if first:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(at, n, first place): occurrences that go on where the one before does, here and there, are one."""
        if not self.any:
            return []
        found = [(doc, key, last - end, end - n + 1, n) for end, (n, doc, key, last) in self.automaton.iter(text)]
        if len(found) > 1:
            found.sort()
        out: list[list[int]] = []
        for doc, key, shift, at, n in found:
            now = out[-1] if out else None
            if now and now[2:] == [doc, key, shift] and at <= now[0] + now[1]:
                now[1] = max(now[1], at + n - now[0])
            else:
                out.append([at, n, doc, key, shift])
        return [(at, n, doc, key, shift + at) for at, n, doc, key, shift in out]


def letter(k: int) -> str:
    """The k-th letter, without the surrogates."""
    return chr(k if k < 0xD800 else k + 0x800)


def passed(texts: list[tuple[int, int, str]], automaton: Located) -> Iterator[tuple[int, int, list]]:
    for gram, whole, text in texts:
        hits = automaton.hits(text)
        if hits:
            yield gram, whole, hits


def remove_repeats(docs: DataFrame, size: int = 20, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, removed, kept): the removed runs of words, and the words left, joined by spaces."""
    rows = identified(docs, text_col)
    found = recurring(rows, lambda: word_codes, size, GRAM)
    kinds, each = summed(found)
    wanted = each.where("several or n > 1").select("gram", "whole", "several", (F.col("n") > 1).alias("repeats"), "rep.*")
    said = materialize(passages(rows, wanted, size), "passages")
    forget(kinds)
    phrases = materialize(confirmed(said), "phrases")
    forget(said)
    hits = materialize(occurrences(sharded(phrases, size), size), "hits")
    forget(phrases)
    later = F.filter("hits", lambda h: F.struct("doc_id", "key", F.col("first") + h["at"]) > F.struct(h["doc_id"], h["key"], h["first"]))
    spans = F.transform(later, lambda h: F.struct((F.col("first") + h["at"]).alias("start"), (F.col("first") + h["at"] + h["n"]).alias("end")))
    here = found.join(hits, ["gram", "whole"]).select("doc_id", "key", spans.alias("spans")).where(F.size("spans") > 0)
    lists = materialize(here.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    forget(found, hits)

    def run(batches):
        for part, packs in batch_pieces(batches, 1):
            cut, kept = Words(unpacked(packs)), []
            row, start, end = merged(part.column(2))
            a, b = start + cut.ends[row], end + cut.ends[row]
            upto = np.searchsorted(row, np.arange(len(packs) + 1))
            plain, spot = cut.plain, cut.spot
            # the gaps between runs stay: from a text's first word or a run's end to the next run or the text's end
            low, high = spot[np.insert(b, upto[:-1], cut.ends[:-1])].tolist(), spot[np.insert(a, upto[1:], cut.ends[1:])].tolist()
            gaps = (upto + np.arange(len(upto))).tolist()
            for x, y in zip(gaps, gaps[1:], strict=False):
                kept.append(b"".join([plain[p:q] for p, q in zip(low[x:y], high[x:y], strict=True)])[:-1].decode())
            runs = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"]))
            ids = part.column(0)
            ids = pc.if_else(pc.equal(ids, NO_ID), pa.scalar(None, pa.int64()), ids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(cut.ends), pa.int64()), runs, pa.array(kept, pa.string())], ["doc_id", "n_words", "removed", "kept"])

    return arrow_map(packed(rows).join(lists, ["doc_id", "key"], "left").select("doc_id", "raw", "spans"), run, OUT)


def merged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end): the unions of the spans of each row, in order; a null row has none."""
    own = lists.flatten()
    start, end = (own.field(k).to_numpy().astype(np.int64) for k in ("start", "end"))
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(row * far + end)
    new = np.concatenate([[True], row[1:] * far + start[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)
    return row[new], start[new], reach[last] - row[new] * far


def digests(removed: DataFrame) -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select("doc_id", "n_words", size.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
