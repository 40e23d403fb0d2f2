"""Byte and word windows that recur, against brute force."""

import collections
import hashlib
import itertools
import random

import pytest

from lexspan.llm import _windows, phrase_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, source string, gram long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def bytes_left(rows, size):
    raws = [(i, (t or "").encode()) for i, t in rows]
    counts = collections.Counter(b[p : p + size] for _, b in raws for p in range(len(b) - size + 1))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if counts[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, y in zip(b, gone) if not y))))
    return sorted(out, key=str)


def words_left(rows, size):
    seen, found = set(), {}
    for i, b in sorted({(i, (t or "").encode()) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = b.split()
        gone = [0] * len(words)
        for p in range(len(words) - size + 1):
            window = tuple(words[p : p + size])
            if window in seen:
                gone[p : p + size] = [1] * size
            seen.add(window)
        found[i, b] = (i, len(words), sum(gone), sha(b" ".join(x for x, y in zip(words, gone) if not y)))
    return sorted((found[i, (t or "").encode()] for i, t in rows), key=str)


def corpus(seed, letters, sep):
    rng = random.Random(seed)
    shared = [sep.join(rng.choice(letters) for _ in range(rng.randint(5, 120))) for _ in range(10)]
    part = lambda: rng.choice(shared) if rng.random() < 0.6 else sep.join(rng.choice("xyz") for _ in range(rng.randint(1, 40)))
    rows = [(k, rng.choice([" ", "\n", "\t "]).join(part() for _ in range(rng.randint(0, 7)))) for k in range(90)]
    # nulls, empties, one long run, overlapping repeats, a repeated row, a null id, an id with two texts
    return [*rows, (200, None), (201, ""), (202, sep.join("a" * 900)), (203, sep.join("ab" * 200)), (5, rows[5][1]), (None, rows[7][1]), (-3, rows[9][1])]


@pytest.mark.parametrize("size", [60, 101])
def test_bytes(spark, size):
    rows = corpus(3, "abc é", "")
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(frame(spark, rows), size))
    assert sorted((tuple(r) for r in got.collect()), key=str) == bytes_left(rows, size)


@pytest.mark.parametrize(("size", "limits"), [(20, (200_000, 1_000_000, 200_000)), (7, (50, 1_000_000, 200_000)), (7, (2000, 60, 5))])
def test_words(spark, monkeypatch, size, limits):
    """One shard, many shards, and shards that are cut into automata and streams."""
    for name, limit in zip(("SHARD_WORDS", "MOST_WORDS", "MOST_TEXTS"), limits, strict=True):
        monkeypatch.setattr(phrase_dedup, name, limit)
    rows = corpus(4, ["a", "bé", "c", "d%", "e\xa0f"], " ")
    got = phrase_dedup.digests(phrase_dedup.remove_repeats(frame(spark, rows), size))
    assert sorted((tuple(r) for r in got.collect()), key=str) == words_left(rows, size)


def test_automaton_locates_in_unseen_texts():
    """Phrases of one text are found in texts that gave none, wherever they stand."""
    phrases = phrase_dedup.Phrases(3)
    phrases.add("a b c d e".split(), (4, 0, 10), True, [1])
    phrases.add("x y z".split(), (2, 0, 0), False, [0])
    located = phrases.compiled()
    assert located.hits(phrases.text("q a b c d e q b c d".split())) == [(7, 3, 4, 0, 11), (1, 5, 4, 0, 10)]
    assert located.hits(phrases.text("x y z x y z x y".split())) == [(3, 3, 2, 0, 0), (0, 3, 2, 0, 0)]
    assert located.hits(phrases.text("a b c d".split())) == [(1, 3, 4, 0, 11)] and phrase_dedup.Located({}).hits("ab") == []


def test_words_of_texts():
    rng = random.Random(7)
    raws = ["".join(rng.choice("ab\u00e9 \t\n\x0b\x0c\r\x1c\x85\xa0") for _ in range(rng.randint(0, 30))).encode() for _ in range(300)]
    words = _windows.Words(raws)
    cut = [r.split() for r in raws]
    assert words.ends.tolist() == [0, *itertools.accumulate(map(len, cut))]
    assert words.plain == b"".join(w + b" " for c in cut for w in c)
    names = {}
    for w, code in zip((w for c in cut for w in c), words.codes.tolist(), strict=True):
        assert names.setdefault(w, code) == code
    assert len(set(names.values())) == len(names)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffix_dedup.remove_repeats(none).count() == 0 and phrase_dedup.remove_repeats(none).count() == 0


def test_real_outputs(spark):
    text = "x" * 10 + "".join(chr(97 + k * 7 % 26) for k in range(500))
    rows = suffix_dedup.remove_repeats(frame(spark, [(1, text), (2, "y" + text[10:])])).orderBy("doc_id").collect()
    assert [(r.removed[0].start, r.removed[0].end, bytes(r.kept)) for r in rows] == [(10, 510, b"x" * 10), (1, 501, b"y")]
