"""Spelling variants against brute force, with long words, ties and odd tables."""

import random
import zlib
from collections import Counter

import pytest

from lexspan.llm import spelling
from lexspan.llm.queries import op11_spelling

DOCS = "doc_id long, text string, rank long, word string, lexspan_h long"


def apart(a, b):
    """Whether exactly one inserted, deleted or replaced letter lies between two words."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, ratio=2):
    near = {w: [x for x in counts if x != w and apart(w, x)] for w in counts}
    top = {w: min(near[w], key=lambda x: (-counts[x], x)) if near[w] else None for w in counts}
    form = {w: f if f and counts[f] >= ratio * counts[w] else None for w, f in top.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def told(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.fixture
def short_limit(monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 6)


def random_words(seed, sizes, number):
    rng = random.Random(seed)
    return {"".join(rng.choice("abé") for _ in range(rng.choice(sizes))): rng.choice([3, 4, 6, 8, 12, 24, 48]) for _ in range(number)}


def test_variants_are_brute_force(spark):
    counts = random_words(1, [5, 6, 7, 8], 300)
    got = told(spelling.group_variants(spark.createDataFrame([*counts.items()], "word string, n long")))
    assert got == brute(counts)
    assert any(v[1] not in (v[0], None) and v[0] for v in got.values()), "some ways have two steps"


def test_named_keys_are_brute_force(spark, short_limit):
    counts = random_words(2, [5, 6, 7, 8, 9], 300)
    assert told(spelling.group_variants(spark.createDataFrame([*counts.items()], "word string, n long"))) == brute(counts)


def test_very_long_words(spark):
    word = "acgt" * 10_000
    counts = {word: 40, word[:777] + word[778:]: 10, word[:777] + "x" + word[778:]: 5, word[1:]: 3, word + "aa": 3}
    assert told(spelling.group_variants(spark.createDataFrame([*counts.items()], "word string, n long"))) == brute(counts)


def test_one_letter_everywhere(spark):
    """A hub with a neighbour for each letter and place, all of one count: ties go to code-point order."""
    hub = "mnopq"
    counts = {hub: 1000} | {hub[:k] + c + hub[k + 1 :]: 7 for k in range(5) for c in "abcdefghijkléÿ"}
    got = told(spelling.group_variants(spark.createDataFrame([*counts.items()], "word string, n long")))
    assert got == brute(counts) and got[hub][3] == 5 * 14


def test_query_reads_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Wörter", "worter", "Forest", "forrest", "FORESTS", "forêt", "abcde", "tree"]) for _ in range(rng.randint(0, 60))) + ".1x" for _ in range(60)]
    rows = [(k, t, 1, "w", 2) for k, t in enumerate(texts)] + [(7, None, 1, "w", 2), (8, "", 1, "w", 2), (None, "forest Forest foresT", 1, "w", 2), (3, texts[3], 1, "w", 2), (4, "z" * 30_000, 1, "w", 2)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    seen = Counter()
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text, *_ in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if "A" <= c <= "Z" or "a" <= c <= "z" or "\xc0" <= c <= "\xff":
                run += c
            elif run:
                word = run.translate(small)
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
                seen[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
                run = ""
    assert told(op11_spelling(spark, str(tmp_path))) == brute({w: n for w, n in seen.items() if len(w) >= 5 and n >= 3})
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    assert op11_spelling(spark, f"{tmp_path}/none").collect() == []
