"""Near-duplicates of texts and vectors against brute force, components, and the pipeline."""

import math
import random

import numpy as np
import pytest

from lexspan.llm import embedding_dedup, near_dedup
from lexspan.llm._shared import connected_components


class Union(dict):
    def top(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.top(x), self.top(y)
        self[max(x, y)] = min(x, y)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(30)] + [(500, 500 + k) for k in range(60)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {x: union.top(x) for e in edges for x in e if e[0] != e[1]} | {x: got[x] for x in got if x not in {y for e in edges if e[0] != e[1] for y in e}}


def near_texts():
    rng = random.Random(2)
    vocabulary = [chr(97 + rng.randrange(26)) * rng.randint(1, 3) + str(k) for k in range(300)]
    rows = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 7)):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return [*rows, (1000, None), (1001, ""), (1002, "A b"), (1003, "a  B"), (1004, "a c"), (None, rows[0][1]), (1, rows[1][1]), (2, "an id with another text too"), (1005, rows[3][1].upper())]


@pytest.mark.parametrize(("leaf", "depth", "levels"), [(400, 10, 6), (3, 2, 3), (3, 0, 1)])
def test_near_texts(spark, monkeypatch, leaf, depth, levels):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    monkeypatch.setattr(near_dedup, "DEPTH", depth)
    monkeypatch.setattr(near_dedup, "LEVELS", levels)
    rows, sets, union = near_texts(), [], Union()
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                union.join(a, b)
    want = [(a, len(s), None if a is None else union.top(a), a is None or union.top(a) == a) for (a, _), s in zip(rows, sets, strict=True)]
    got = near_dedup.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_large_families(spark):
    """Each copy is at 0.90 of its family's first text, most copies at 0.81 of one another: one component, however large its nodes."""
    rng, rows, first = random.Random(5), [], []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(100)]
        first += [len(rows)] * 3000
        rows.append((len(rows), " ".join(base)))
        for k in range(2999):
            words = list(base)
            words[rng.randrange(5, 95)] = f"f{family}x{k}"
            rows.append((len(rows), " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.component_id for r in got.orderBy("doc_id").collect()] == first


def test_hot_tokens_branch(spark, monkeypatch):
    """Unlike sets that share their first minwise tokens are dealt on by branching; pairs below stay together."""
    monkeypatch.setattr(near_dedup, "LEAF", 20)
    rng = np.random.default_rng(1)
    sigs = rng.integers(0, 1 << 30, (200, near_dedup.POSITIONS))
    sigs[:, :] = np.where(rng.random(near_dedup.POSITIONS) < 0.3, sigs[0], sigs)  # three in ten positions say the same everywhere
    sigs[1::2] = np.where(rng.random((100, near_dedup.POSITIONS)) < 0.9, sigs[::2], sigs[1::2])  # pairs at 0.9
    small, stuck = near_dedup.leaves(spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(sigs)], "id long, sig array<int>"))
    together = {}
    for r in small.union(stuck).collect():
        together.setdefault(r.node, set()).add(r.id)
    assert all(any({k, k + 1} <= ids for ids in together.values()) for k in range(0, 200, 2))
    assert small.where("n > 20").count() == 0


def near_rows():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(50):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, (centre + rng.normal(size=16) * 0.12).tolist()) for k in range(rng.integers(1, 8))]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15]
    rows += [(900 + k, v) for k, v in enumerate(odd)]
    return rows + [(950, rows[0][1]), (951, rows[0][1]), (950, rows[0][1]), (None, rows[0][1]), (952, [1.0, 2.0]), (953, [2.0, 4.0])]


@pytest.mark.parametrize("slab", [4096, 30])
def test_near_vectors(spark, monkeypatch, slab):
    monkeypatch.setattr(embedding_dedup, "SLAB", slab)
    rows = near_rows()
    usable = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    vectors = {(i, tuple(np.float32(v).tolist())): np.float64(np.float32(v)) for i, v in rows if i is not None and usable(v)}
    links, union = dict.fromkeys(vectors, 0), Union()
    for x in vectors:
        for y in vectors:
            a, b = vectors[x], vectors[y]
            if x < y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[x] += 1
                links[y] += 1
                union.join(x[0], y[0])
    want = [(i, links.get((i, tuple(np.float32(v).tolist())), 0) if usable(v) else 0, None if i is None else union.top(i), i is None or union.top(i) == i) for i, v in rows]
    got = embedding_dedup.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, n int")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_many_near_copies(spark, monkeypatch):
    """A group of like vectors over several slabs: exact numbers of links, one component; recall at the threshold."""
    monkeypatch.setattr(embedding_dedup, "SLAB", 100)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=24)
    like = [centre + rng.normal(size=24) * 0.12 for _ in range(400)]
    edge = []
    for _ in range(300):  # pairs just above the threshold
        a, b = rng.normal(size=(2, 24))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        c = 0.9505
        edge += [a, c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)]
    x = np.array([*like, *edge])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.95).sum(1) - 1
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(rows).collect()}
    told = np.array([got[k].n_links for k in range(len(x))])
    assert (told <= want).all() and told[:400].sum() >= 0.998 * want[:400].sum() and told[400:].sum() >= 0.99 * want[400:].sum()
    assert {got[k].component_id for k in range(400) if want[k]} == {min(k for k in range(400) if want[k])}


def test_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(1, 4)))
    item = " ".join(word() for _ in range(30))
    texts = []
    for k in range(400):
        words = [word() for _ in range(60)]
        if k % 8 == 0:
            words[5:5] = ["vileword", "scumline"]
        texts.append(" ".join(words))
    near = texts[5].split()
    near[55] = "changed"  # 51 of 61 shingles are shared
    texts += [texts[1], texts[1] + " x", f"{texts[2]} {item} {texts[3]}", "clean password: hunter2222 text", None, "", " ".join(near)]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i for i in ids if not (i < 400 and i % 8 == 0) and i not in (400, 401, 402, 406)}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    assert {r.text for r in step.where("doc_id = 403").collect()} == {"clean [SECRET] text"}
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, an id with two texts, long texts and extra columns: clean rows stay, none crashes; empty tables give none."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kind = "doc_id long, text string, lang string, source string, n_chars long, node string, id int, parent int, n int"
    long = " ".join(f"w{k}" for k in range(60_000))
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (1, "quite another text under one id"), (2, None), (3, ""), (None, "a row without an id"), (None, "a row without an id"), (4, long), (5, long + " more"), (6, "alpha beta gamma delta epsilon zeta")]
    rows = [(i, t, None if k == 3 else "en", "s", len(t or ""), "x", 1, 2, 3) for k, (i, t) in enumerate(texts)]
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string")
    for name, keep in (("full", True), ("empty", False)):
        path = f"{tmp_path}/{name}"
        for table, df in (("documents", spark.createDataFrame(rows, kind)), ("labels", labels), ("benchmark", items)):
            (df if keep else df.where("false")).write.parquet(f"{path}/{table}.parquet")
        got = sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, path).collect())
        assert got == (["1", "1", "2", "3", "4", "None", "None"] if keep else [])


def test_long_texts(spark):
    """Texts of a megabyte that differ in one word are near copies; their windows recur."""
    from lexspan.llm import phrase_dedup, suffix_dedup

    words = [f"w{k}" for k in range(150_000)]
    other = [*words[:70_000], "changed", *words[70_001:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [r.component_id for r in near_dedup.near_duplicates(docs).collect()] == [1, 1]
    left = {r.doc_id: r for r in phrase_dedup.remove_repeats(docs).collect()}
    assert (left[1].n_words, left[1].removed, left[2].kept) == (150_000, [], "changed")
    gone = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert (bytes(gone[1].kept), bytes(gone[2].kept)) == (b"w70000", b"changed")
