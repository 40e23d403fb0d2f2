"""Byte-level BPE encoding and decoding with a contiguous rank array for each short word.

The text is cut into words by the vocabulary's own pattern. A word is a list of parts, first its
bytes, beside a list of the merge ranks of adjacent parts. The least rank is found by a scan, the
boundary behind it is deleted, and the ranks of the two neighbours are looked up again, until no
adjacent pair has a rank. New words of one length go through these steps together, as rows of a
matrix. Words over ``LONG`` bytes keep the same order of merges in a heap over a
linked list, as repeated scans would take quadratic time.

Null texts are empty, empty texts have no tokens, texts of any length are encoded whole, repeated rows alike; an empty
table gives an empty one, and a column with the name of a result gives way to it. Vocabulary
files are parameters, read where the work is done and never copied.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm._shared import append_columns, arrow_map

#: From this many bytes a word's merges are kept in a heap.
LONG = 200
#: Words whose encoding a task remembers; at the bound it starts anew.
CACHE_WORDS = 200_000
#: Words of one length that are merged together.
ROWS = 2048
NO_RANK = (1 << 31) - 1
#: The pattern of byte-level vocabularies, with Unicode's own white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same pattern for texts of ASCII and Latin letters, which the faster standard library cuts alike.
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]")
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+| ?[0-9]+| ?[^\sA-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f0-9]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


class Vocabulary:
    """Merge ranks and token bytes of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        ids: dict[str, int] = model["vocab"]
        self.of_byte = [ids[c] for c in letters]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(ids[left] << 20 | ids[right], len(self.merged))
            self.merged.append(ids[left + right])
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in ids.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        self.bytes_of |= {i: token.encode() for token, i in added.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.words = regex.compile(WORDS)
        self._forget()
        self._index()

    def merge_word(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        of_byte, rank_of, merged = self.of_byte, self.ranks.get, self.merged
        parts = [of_byte[b] for b in word]
        if len(parts) > LONG:
            return self._merge_long(parts)
        ranks = [rank_of(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 20 | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 20 | parts[i + 1], NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        rank_of, n = self.ranks.get, len(parts)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], bytearray(b"\1" * n)
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := rank_of(parts[i] << 20 | parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = self.merged[r], 0
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p, live in zip(parts, alive, strict=True) if live]

    def merge_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of many words: the same steps as ``merge_word``, for all words of a length at once."""
        found: list[tuple[int, ...]] = [()] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_size.setdefault(len(word), []).append(k)
        of_byte = np.array(self.of_byte, np.int32)
        for size, own in ((size, same[k : k + ROWS]) for size, same in by_size.items() for k in range(0, len(same), ROWS)):
            if size < 2 or size > LONG or len(own) < 8:
                for k in own:
                    found[k] = tuple(self.merge_word(words[k]))
                continue
            parts = of_byte[np.frombuffer(b"".join([words[k] for k in own]), np.uint8).reshape(-1, size)]
            ranks = np.full((len(own), size), NO_RANK, np.int32)
            ranks[:, :-1] = self._ranks(parts[:, :-1], parts[:, 1:])
            at, sizes = np.array(own), np.full(len(own), size)
            while len(at):
                i = ranks.argmin(axis=1)
                row = np.arange(len(at))
                least = ranks[row, i]
                go = least < NO_RANK
                if not go.all():
                    for r in np.flatnonzero(~go).tolist():
                        found[at[r]] = tuple(parts[r, : sizes[r]].tolist())
                    parts, ranks, at, sizes, i, least = parts[go], ranks[go], at[go], sizes[go], i[go], least[go]
                    row = np.arange(len(at))
                    if not len(at):
                        break
                parts[row, i] = self.merged_ids[least]
                # delete the boundary behind i: what stands after it moves up by one
                width = parts.shape[1]
                moved = np.arange(width - 1)[None, :] > i[:, None]
                parts = np.where(moved, parts[:, 1:], parts[:, :-1])
                moved = np.arange(width - 1)[None, :] >= i[:, None]
                ranks = np.where(moved, ranks[:, 1:], ranks[:, :-1])
                sizes = sizes - 1
                left = i > 0
                ranks[row[left], i[left] - 1] = self._ranks(parts[row[left], i[left] - 1], parts[row[left], i[left]])
                right = i + 1 < sizes
                ranks[row[right], i[right]] = self._ranks(parts[row[right], i[right]], parts[row[right], i[right] + 1])
                ranks[row[~right], i[~right]] = NO_RANK
        return found

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, NO_RANK where there is none: open addressing with linear probes."""
        key = a.astype(np.int64) << 20 | b
        slot = (key * 0x9E3779B97F4A7C1) >> 20 & self.slot_mask
        got = self.slot_key[slot]
        rank = np.where(got == key, self.slot_rank[slot], np.int32(NO_RANK))
        open_ = np.flatnonzero((got != key).ravel() & (got >= 0).ravel())
        if len(open_):
            key, slot, flat = key.ravel()[open_], slot.ravel()[open_], rank.ravel()
            while len(open_):
                slot = slot + 1 & self.slot_mask
                got = self.slot_key[slot]
                hit = got == key
                flat[open_[hit]] = self.slot_rank[slot[hit]]
                go = ~hit & (got >= 0)
                open_, key, slot = open_[go], key[go], slot[go]
            rank = flat.reshape(rank.shape)
        return rank

    def _index(self) -> None:
        size = 1 << 19
        self.slot_mask = size - 1
        self.slot_key, self.slot_rank = np.full(size, -1), np.zeros(size, np.int32)
        for key, rank in self.ranks.items():
            slot = int(np.int64(np.uint64(key * 0x9E3779B97F4A7C1 & (1 << 64) - 1).astype(np.int64)) >> 20) & self.slot_mask
            while self.slot_key[slot] >= 0:
                slot = slot + 1 & self.slot_mask
            self.slot_key[slot], self.slot_rank[slot] = key, rank
        self.merged_ids = np.array(self.merged, np.int32)
        most = max(self.bytes_of) + 1
        self.token_size = np.zeros(most, np.int64)
        for i, raw in self.bytes_of.items():
            self.token_size[i] = len(raw)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join([self.bytes_of.get(i, b"") for i in range(most)]), np.uint8)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids end."""
        cut: list[list[str]] = []
        for text in texts:
            words: list[str] = []
            for i, part in enumerate(self.split.split(text) if self.split else [text]):
                if i % 2:
                    words.append(part)
                else:
                    words += PLAIN_WORDS.findall(part) if not NOT_PLAIN.search(part) else self.words.findall(part)
            cut.append(words)
        new = set().union(*cut).difference(self.place)
        if len(self.place) + len(new) > CACHE_WORDS:
            self._forget()
            new = set().union(*cut).difference(self.place)
        todo = list(new)
        made = self.merge_words([w.encode("utf-8", "surrogatepass") for w in todo])
        self.place.update(zip(todo, range(len(self.word_size), len(self.word_size) + len(todo)), strict=True))
        self.word_size = np.concatenate([self.word_size, np.fromiter(map(len, made), np.int64, len(made))])
        self.word_at = np.cumsum(self.word_size) - self.word_size
        self.word_ids = np.concatenate([self.word_ids, np.fromiter(chain.from_iterable(made), np.int32)])
        counts = [len(words) for words in cut]
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, sum(counts))
        sizes = self.word_size[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.word_ids[np.repeat(self.word_at[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]

    def _forget(self) -> None:
        """Only the added tokens are known words."""
        self.place = {token: k for k, token in enumerate(self.added)}
        self.word_ids = np.array([*self.added.values()], np.int32)
        self.word_size = np.ones(len(self.added), np.int64)
        self.word_at = np.arange(len(self.added))

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of id lists that stand one after another; see ``decode``."""
        sizes = self.token_size[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.token_bytes[np.repeat(self.token_at[ids] - upto[:-1], sizes) + np.arange(upto[-1])].tobytes()
        at = upto[ends].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]

    def encode(self, text: str) -> list[int]:
        """Ids of one whole text."""
        return self.encode_batch([text])[0].tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of.get(i, b"") for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of each whole text and the text decoded from these ids."""

    def make():
        vocab = vocabulary(vocab_path)

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [text or "" for text in texts.to_pylist()]
            ids, ends = vocab.encode_batch(rows)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            return [lists, pa.array(vocab.decode_batch(ids, ends), pa.string())]

        return work

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())]
    return append_columns(docs, text_col, fields, make)


def decode(tokens: DataFrame, vocab_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its id lists; a null list is an empty text."""

    def make():
        vocab = vocabulary(vocab_path)
        return lambda lists: [pa.array([vocab.decode(x or []) for x in lists.to_pylist()], pa.string())]

    tokens = tokens.drop(decoded_col)
    schema = T.StructType([*tokens.schema.fields, T.StructField(decoded_col, T.StringType())])
    at = tokens.columns.index(ids_col)

    def run(batches):
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(at))], [f.name for f in schema.fields])

    return arrow_map(tokens, run, schema)


def digests(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """doc_id with token count and digests of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col).cast("binary"), 256).alias("decoded_sha256"),
    )
