"""Encoding and decoding with merge-type SentencePiece vocabularies by a score-ordered agenda.

The text, with a leading mark and a mark for each space, is a row of symbols, first its characters.
All adjacent pairs that are pieces stand in an agenda ordered by score, then by place. The best pair
is taken and, if both of its symbols are still there, merged; the merged symbol's pairs with its two
neighbours join the agenda. What is left when the agenda is empty are the pieces; a symbol that is no
piece becomes its bytes. The text is first cut at places over which no piece of the vocabulary
reaches, so that equal words are merged once and what a task remembers stays bounded.

``agreement`` holds whole tables against the sentencepiece library, one Arrow batch at a time.

Null texts are empty, empty texts have only begin and end ids, texts of any length are encoded whole,
repeated rows alike; an empty table gives an empty one, and a column with the name of a result gives way
to it. Model files are parameters, read where the work is done and never copied. Models
of another type, with a normalization table, user-defined symbols or unused pieces are refused.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm._shared import append_columns, arrow_map, pieces

#: Stands for a space.
MARK = "▁"
#: Words over this many characters are cut again before they are merged.
LONG = 500
#: Words whose encoding a task remembers; at the bound it starts anew.
CACHE_WORDS = 600_000
#: Agenda entries are one number: rank of the score, place, length of the merged piece.
PLACE, RANK = 16, 64
#: Types of pieces in model files.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

codecs.register_error("lexspan_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def word_pattern(links: set[str]) -> re.Pattern[str]:
    """Cuts a text at places over which no piece reaches: before marks, around line ends, and after letters.

    ``links`` are the pairs of characters that stand side by side in some piece. Letters that a piece
    carries on with something else don't count as letters; a vocabulary with many of them, or with marks or
    line ends inside its pieces, has its texts merged whole.
    """
    odd = "_"
    while True:
        letter, other = rf"[^\W\d{odd}]", rf"[\W\d{odd}]"
        more = {x[0] for x in links if re.match(letter + other, x)}
        if not more:
            break
        odd += "".join(sorted(more))
    if len(odd) > 100 or any(re.match(rf"\n.|.\n|[^{MARK}]{MARK}", x, re.S) for x in links):
        return re.compile(r"[\s\S]+")
    return re.compile(rf"{MARK}*{letter}+|\n|{MARK}*(?:(?![{MARK}\n]){other})+{letter}*|{MARK}+")


class PieceModel:
    """Pieces, scores and special ids of one model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        trainer, rules = spec.trainer_spec, spec.normalizer_spec
        odd = [
            (trainer.model_type != trainer.BPE, "it is not of the merge type"),
            (bool(rules.precompiled_charsmap), "it has a normalization table"),
            (rules.remove_extra_whitespaces or not rules.escape_whitespaces, "it rewrites white space"),
            (trainer.treat_whitespace_as_suffix, "it marks the ends of words"),
            (any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in spec.pieces), "it has user-defined or unused pieces"),
        ]
        if any(wrong for wrong, _ in odd):
            raise ValueError(f"{path}: " + ", ".join(why for wrong, why in odd if wrong))
        self.prefix = MARK if rules.add_dummy_prefix else ""
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        of_score = {s: r for r, s in enumerate(sorted({spec.pieces[i].score for i in normal.values()}, reverse=True))}
        #: rank and length of each piece that a merge can make
        self.merges = {p: of_score[spec.pieces[i].score] << RANK | len(p) for p, i in normal.items() if len(p) > 1}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.ids = {p: (i,) for p, i in normal.items()}
        of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.of_byte = [of_byte[b] for b in range(256)] if trainer.byte_fallback else None
        named = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == CONTROL}
        self.begin, self.end = named[trainer.bos_piece], named[trainer.eos_piece]
        self.links = {p[k : k + 2] for p in self.merges for k in range(len(p) - 1)}
        self.words = word_pattern(self.links)
        self._table(spec)
        self._forget()

    def _table(self, spec) -> None:
        """What each id stands for, as bytes one after another, and which ids start with a mark that may go."""
        raw = []
        for p in spec.pieces:
            if p.type == BYTE:
                raw.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == CONTROL:
                raw.append(b"")
            elif p.type == UNKNOWN:
                raw.append((spec.trainer_spec.unk_surface or " ⁇ ").encode())
            else:
                raw.append(p.piece.replace(MARK, " ").encode())
        self.said_size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.said_at = np.cumsum(self.said_size) - self.said_size
        self.said = np.frombuffer(b"".join(raw), np.uint8)
        self.silent = np.array([p.type == CONTROL for p in spec.pieces])
        self.single = np.array([p.type == BYTE for p in spec.pieces])
        self.marked = np.array([p.type == NORMAL and p.piece.startswith(MARK) for p in spec.pieces]) & bool(self.prefix)

    def _forget(self) -> None:
        """Only the begin and end ids are known words."""
        self.place: dict[str, int] = {}
        self.word_ids = np.array([self.begin, self.end], np.int32)
        self.word_size = np.ones(2, np.int64)
        self.word_at = np.arange(2)

    def split(self, word: str) -> list[str]:
        """The pieces of one word, by the agenda; characters that are no piece stay as they are."""
        merge_of = self.merges.get
        n = len(word)
        agenda = [m | i << PLACE for i in range(n - 1) if (m := merge_of(word[i : i + 2])) is not None]
        if not agenda:
            return list(word)
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        behind: list[int] | array = [*range(1, n + 1)]
        before: list[int] | array = [*range(-1, n)]
        if n > LONG:
            behind, before = array("q", behind), array("q", before)
        place, size = (1 << RANK - PLACE) - 1, (1 << PLACE) - 1
        while agenda:
            top = pop(agenda)
            left = top >> PLACE & place
            right = behind[left]
            if not right or right >= n:  # the left symbol has gone, or is the last
                continue
            end = behind[right]
            if end - left != top & size:  # one of the two has grown
                continue
            behind[left], behind[right], before[end] = end, 0, left
            if end < n and (m := merge_of(word[left : behind[end]])) is not None:
                push(agenda, m | left << PLACE)
            if left and (m := merge_of(word[before[left] : end])) is not None:
                push(agenda, m | before[left] << PLACE)
        out, i = [], 0
        while i < n:
            out.append(word[i : behind[i]])
            i = behind[i]
        return out

    def merge_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word. A long one is first cut between characters that stand side by side in no piece."""
        whole = self.ids.get(word)
        if whole is not None and len(word) == 1:
            return whole
        if len(word) > LONG:
            links = self.links
            cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in links), len(word)]
            found = chain.from_iterable(self.split(word[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
        else:
            found = self.split(word)
        try:
            return tuple([self.ids[p][0] for p in found])
        except KeyError:
            found = self.split(word) if len(word) <= LONG else [x for a, b in zip(cuts, cuts[1:], strict=False) for x in self.split(word[a:b])]
            return tuple(chain.from_iterable(self.ids.get(p) or self.fallback(p) for p in found))

    def fallback(self, symbol: str) -> tuple[int, ...]:
        """Ids of a character that is no piece: its bytes, if the model has them."""
        return tuple(self.of_byte[b] for b in symbol.encode("utf-8", "surrogatepass")) if self.of_byte else (self.unknown,)

    def encode_batch(self, texts: list[str], add_begin: bool = True, add_end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids start and end."""
        cut = [self.words.findall(self.prefix + text.replace(" ", MARK)) if text else [] for text in texts]
        new = set().union(*cut).difference(self.place)
        if len(self.place) + len(new) > CACHE_WORDS:
            self._forget()
            new = set().union(*cut)
        made = [self.merge_word(w) for w in new]
        self.place.update(zip(new, range(len(self.word_size), len(self.word_size) + len(made)), strict=True))
        self.word_size = np.concatenate([self.word_size, np.fromiter(map(len, made), np.int64, len(made))])
        self.word_at = np.cumsum(self.word_size) - self.word_size
        self.word_ids = np.concatenate([self.word_ids, np.fromiter(chain.from_iterable(made), np.int32)])
        first, last = [0] * add_begin, [1] * add_end
        counts = np.fromiter(map(len, cut), np.int64, len(cut)) + add_begin + add_end
        place = self.place
        at = np.fromiter(chain.from_iterable(chain(first, map(place.__getitem__, words), last) for words in cut), np.int64, int(counts.sum()))
        sizes = self.word_size[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.word_ids[np.repeat(self.word_at[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum(counts)])]

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of id lists that stand one after another. Each byte that is no UTF-8 becomes U+FFFD."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.said_size):
            raise ValueError("an id is out of range")
        sizes = self.said_size[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.said[np.repeat(self.said_at[ids] - upto[:-1], sizes) + np.arange(upto[-1])].tobytes()
        # the mark before a text goes with the first id that is heard
        heard = np.flatnonzero(~self.silent[ids])
        first = np.searchsorted(heard, ends[:-1])
        drop = np.zeros(len(ends) - 1, np.int64)
        has = first < len(heard)
        at = heard[first[has]]
        drop[has] = self.marked[ids[at]] & (at < ends[1:][has])
        starts, stops = (upto[ends[:-1]] + drop).tolist(), upto[ends[1:]].tolist()
        out = [raw[a:b].decode("utf-8", "lexspan_each_byte") for a, b in zip(starts, stops, strict=True)]
        # bytes on both sides of a silent id are no character together
        quiet = np.flatnonzero(self.silent[ids[1:-1]] & self.single[ids[:-2]]) + 1 if len(ids) > 2 else []
        for k in sorted({int(x) for x in np.searchsorted(ends, quiet, "right") - 1}):
            cuts = sorted({starts[k], *(c for c in upto[quiet].tolist() if starts[k] <= c <= stops[k]), stops[k]})
            out[k] = "".join(raw[a:b].decode("utf-8", "lexspan_each_byte") for a, b in zip(cuts, cuts[1:], strict=False))
        return out

    def encode(self, text: str, add_begin: bool = True, add_end: bool = True) -> list[int]:
        """Ids of one whole text."""
        return self.encode_batch([text], add_begin, add_end)[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of one id list."""
        row = np.array([*ids], np.int64)
        return self.decode_batch(row, np.array([0, len(row)]))[0]


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model for each worker process."""
    return PieceModel(path)


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", packed: bool = False, add_begin: bool = True, add_end: bool = True) -> DataFrame:
    """``docs`` with the ids of each whole text and the text decoded from these ids.

    ``packed`` gives the ids as little-endian unsigned 32-bit integers in one binary value instead of an array.
    """

    def make():
        vocab = model(model_path)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids, ends = vocab.encode_batch([text or "" for text in texts.to_pylist()], add_begin, add_end)
            decoded = pa.array(vocab.decode_batch(ids, ends), pa.string())
            if packed:
                raw = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                return [raw, decoded]
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), decoded]

        return work

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    return append_columns(docs, text_col, [T.StructField(ids_col, kind), T.StructField(decoded_col, T.StringType())], make)


def decode(tokens: DataFrame, model_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its id lists; a null list is an empty text."""

    def make():
        vocab = model(model_path)
        return lambda lists: [pa.array([vocab.decode(x or []) for x in lists.to_pylist()], pa.string())]

    tokens = tokens.drop(decoded_col)
    schema = T.StructType([*tokens.schema.fields, T.StructField(decoded_col, T.StringType())])
    at = tokens.columns.index(ids_col)

    def run(batches):
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(at))], [f.name for f in schema.fields])

    return arrow_map(tokens, run, schema)


def agreement(encoded: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", add_begin: bool = True, add_end: bool = True) -> DataFrame:
    """One row: how many rows of ``encode_decode`` (ids as arrays) there are, and how many differ from the
    sentencepiece library in an id or in the decoded text. The library runs over Arrow batches."""
    encoded = encoded.select(text_col, ids_col, decoded_col)

    def run(batches):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(0).to_pylist()]
                want = library.encode(texts, add_bos=add_begin, add_eos=add_end, num_threads=1)
                said = library.decode(want, num_threads=1) if want else []
                wrong = sum(x != y or s != t for x, y, s, t in zip(part.column(1).to_pylist(), want, part.column(2).to_pylist(), said, strict=True))
                yield pa.RecordBatch.from_pydict({"checked": [len(texts)], "differing": [wrong]})

    told = arrow_map(encoded, run, "checked long, differing long")
    return told.agg(F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"), F.coalesce(F.sum("differing"), F.lit(0)).alias("differing"))


def digests(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """doc_id with token count and digests of packed ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.expr(f"octet_length(`{ids_col}`) div 4").alias("n_tokens"),
        F.sha2(ids_col, 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col).cast("binary"), 256).alias("decoded_sha256"),
    )
