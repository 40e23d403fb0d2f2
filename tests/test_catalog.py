"""Registered queries over small tables, whole, against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from lexspan import catalog, registry  # noqa: F401
from lexspan.catalog._stems import stems_sql
from lexspan.functions import text as tx
from lexspan.functions.text import porter
from lexspan.operators import search as se
from lexspan.plans.engine import Engine

TEXTS = {k: f"Alpha w{k} with " + "x y " * 40 + f"late{k} was running" for k in range(1, 45)}


def words(text):
    return re.findall("[a-z0-9]+", text.lower())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_every_document_is_read(spark, folder):
    found = {(r[0], r[1]): r[2] for r in registry.queries()["sparse_annotate"](spark, folder).select("docid", "feature", "v").collect()}
    assert found == {(str(k), f"splade:{w}"): n for k, t in TEXTS.items() for w, n in Counter(words(t)).items()}
    got = Counter((r.doc_id, r.word) for r in registry.queries()["ascii_terms"](spark, folder).collect())
    assert got == Counter((k, w) for k, t in TEXTS.items() for w in t.split())


@pytest.mark.parametrize("ids", [[1, 2, 3, 4, None], [1, 1, 3, None, None]])
def test_build_index(spark, tmp_path, ids):
    """Places and documents of each word; an id that several rows have counts once, no id not at all."""
    texts = ["One two one", "two Three", None, "four one", "one 5"]
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    said = [(w, i) for i, t in zip(ids, texts, strict=True) for w in words(t or "")]
    want = {w: (n, len({i for x, i in said if x == w and i is not None})) for w, n in Counter(w for w, _ in said).items()}
    want[":item"] = (len({i for _, i in said if i is not None}),) * 2
    got = registry.queries()["build_index"](spark, str(tmp_path))
    assert {r.feature: (r.n, r.df) for r in got.collect()} == want and dict(got.dtypes) == {"feature": "string", "n": "bigint", "df": "bigint"}


def test_long_spans_and_all_scores(spark, folder):
    found = {r.doc_id: r.said for r in registry.queries()["translate_span"](spark, folder).collect()}
    assert found == {k: " ".join(words(t)[2:-1]) for k, t in TEXTS.items()}
    vectors = {k: [math.sin(k + j) * 0.3 for j in range(3)] for k in range(45)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    dot = {(i, j): sum(a * b for a, b in zip(vectors[i], vectors[j], strict=True)) for i in vectors for j in vectors if i % 20 == 0}
    got = {(r.topic, r.doc_id): r.score for r in registry.queries()["dot_product"](spark, folder).collect()}
    assert got == pytest.approx({k: v for k, v in dot.items() if v > 0}, abs=1e-5)


def test_forager(spark, folder):
    tf = {(k, w): n for k, t in TEXTS.items() for w, n in Counter(words(t)).items()}
    df = Counter(w for _, w in tf)
    stemmed = Counter()
    for (k, w), n in tf.items():
        stemmed[k, porter(w)] += n
    want = {(f"@tf-idf:{w}", k): n * math.log(len(TEXTS) / df[w]) for (k, w), n in tf.items()}
    want |= {(f"@tf-idf:tf:{w}", k): n for (k, w), n in stemmed.items()} | {(f"@tf-idf:df:{w}", 1): n for w, n in Counter(w for _, w in stemmed).items()}
    want |= {("@tf-idf:total:items", 1): len(TEXTS), ("@tf-idf:total:length", 1): sum(tf.values())}
    got = {(r.feature, r.doc_id): r.v for r in registry.queries()["forage_tfidf"](spark, folder).collect()} | {(r.feature, r.doc_id): r.v for r in registry.queries()["forage_stats"](spark, folder).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_feedback_around_passages(spark, tmp_path):
    texts = [" ".join(f"d{k}w{j}" for j in range(100)) + (" needle hay companion" if k < 3 else "") for k in range(8)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "needle hay")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.topic, r.term): r.score for r in registry.queries()["qa_prf"](spark, str(tmp_path)).collect()}
    chance = 4 / (809 + 803)
    score = lambda gap: 3 * math.log(1 / (1 - (1 - chance) ** gap))
    assert got == pytest.approx({(7, "needle"): score(2), (7, "hay"): score(2), (7, "companion"): score(1)}, abs=1e-5)


def stem(word):
    return word if porter(word) == word else f"porter:{porter(word)}"


class Shelf:
    """Texts with the counts of their words and, beside them, of the stems that differ."""

    def __init__(self, texts):
        self.said = {k: words(t) for k, t in texts.items()}
        self.tf = {k: Counter(ws) + Counter(s for s in map(stem, ws) if s.startswith("porter:")) for k, ws in self.said.items()}
        self.df = Counter(w for c in self.tf.values() for w in c)
        self.mean = sum(map(len, self.said.values())) / len(texts)

    def rsj(self, term):
        return max(0.0, math.log((len(self.said) - self.df[term] + 0.5) / (self.df[term] + 0.5)))

    def bm25(self, query, depth, k1=0.5, b=0.25):
        """The best (document, score) of a query, term to weight."""
        scores = {}
        for k, tf in self.tf.items():
            gains = [w * self.rsj(t) * tf[t] / (k1 * (1 - b + b * len(self.said[k]) / self.mean) + tf[t]) for t, w in query.items() if tf[t] and self.rsj(t)]
            if gains:
                scores[k] = round(sum(gains), 6)
        return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:depth]

    def wider(self, query, run, most, gamma):
        """The query with the words of a run's documents that have the highest sums of weights, ``gamma`` each."""
        f = Counter(w for k, _ in run for w in set(self.said[k]))
        score = {w: round(n * self.rsj(w), 9) for w, n in f.items() if self.rsj(w)}
        return Counter(query) + Counter({w: gamma for w in sorted(score, key=lambda w: (-score[w], w))[:most]})


def stemmed(query):
    found = Counter()
    for w, n in query.items():
        found[stem(w)] += n
    return found


def shelves(seed, many):
    """Texts of words in several forms, some words rarer than others."""
    rng = random.Random(seed)
    forms = [b + e for b in ("jump", "walk", "talk", "lift", "paint", "count", "hunt", "rest", "form", "print", "sort", "need") for e in ("", "s", "ed", "ing")]
    weights = [1 / (k % 13 + 1) for k in range(len(forms))]
    return {k: " ".join(rng.choices(forms, weights, k=rng.randint(3, 12))) for k in range(many)}


def test_two_passes_by_stems(spark, tmp_path):
    """The words that feedback adds have the same weight and are stemmed before the second ranking."""
    texts, topics = shelves(1, 70), {3: "the walking rests", 4: "painted forms sorting needs", 5: "hunting"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(topics.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shelf, want = Shelf(texts), {}
    for topic, text in topics.items():
        first = stemmed(Counter(w for w in words(text) if w != "the"))
        second = stemmed(shelf.wider(first, shelf.bm25(first, 10), 25, 0.2))
        want |= {(topic, k, n): s for n, (k, s) in enumerate(shelf.bm25(second, 20), 1)}
    got = {(r.topic, r.doc_id, r["rank"]): r.score for r in registry.queries()["pipeline_bm25_rsj"](spark, str(tmp_path)).collect()}
    # the third topic has no ranking: its stem stands in most texts
    assert got == pytest.approx(want, abs=2e-6) and len(got) == 40


def test_feedback_reads_its_own_depth(spark, tmp_path):
    """``depth`` of ``rsj`` says how many ranked documents tell words."""
    texts = shelves(2, 50)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    topics, shelf = spark.createDataFrame([(1, "walking lifted")], "item_id long, text string"), Shelf(texts)
    query = Counter(words("walking lifted"))
    want = shelf.bm25(shelf.wider(query, shelf.bm25(query, 20), 6, 0.2), 9)
    got = [(r.doc_id, r.score) for r in se.Pipeline("bm25:depth=20 rsj:depth=20,expansions=6 bm25:depth=9").run(Engine(docs), topics).orderBy("rank").collect()]
    assert got == [(k, pytest.approx(s, abs=2e-6)) for k, s in want]


def best_cover(said, weight):
    """(score, p, q) of the best cover of some terms, or of a single one."""
    found = []
    for p, word in enumerate(said):
        if word in weight:
            ahead = sorted((said.index(t, p), w) for t, w in weight.items() if t in said[p:])
            for n in range(1, len(ahead) + 1):
                q, score = ahead[n - 1][0], sum(w for _, w in ahead[:n])
                score -= n * math.log(q - p + 1) if n > 1 else 0
                if n == 1 or round(score, 9) > 0:
                    found.append((-round(score, 9), p, q))
    return min(found, default=None)


def test_fusion_with_feedback_from_another_collection(spark, tmp_path):
    """Words around the best covers in the documents rank the turns by stems; the other ranking is two passes over the turns."""
    texts, said = shelves(3, 45), shelves(4, 60)
    topics = {1: "the walking rests", 2: "painted forms sorting needs needs", 3: "nowhere"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k // 4, k % 4, "user", t) for k, t in said.items()], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(list(topics.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns, docs = Shelf({k // 4 * 1_000_000 + k % 4: t for k, t in said.items()}), {k: words(t) for k, t in texts.items()}
    cf = Counter(w for ws in docs.values() for w in ws)
    size, want = sum(cf.values()) + len(cf), Counter()
    for topic, text in topics.items():
        query = Counter(words(text))
        weight = {w: math.log(size / (cf[w] + 1)) for w in query if w in cf}
        covers = sorted((cover[0], k, *cover[1:]) for k, ws in docs.items() if (cover := best_cover(ws, weight)))[:32]
        f, e = Counter(), Counter()
        for _, k, p, q in covers:
            gaps = {}
            for at, w in enumerate(docs[k]):
                if p - 64 <= at <= q + 64:
                    gap = q - at if at < p else q - p + 1 if at <= q else at - 1 - p
                    gaps[w] = min(gaps.get(w, gap), max(gap, 1))
            for w, gap in gaps.items():
                f[w] += 1
                e[w] += 1 - (1 - (cf[w] + 1) / size) ** max(gap, 1)
        score = {w: round(n * math.log(n / e[w]), 6) for w, n in f.items() if n > 1}
        fed = stemmed({w: score[w] for w in sorted(score, key=lambda w: (-score[w], w))[:16]})
        wider = stemmed(turns.wider(stemmed(query), turns.bm25(stemmed(query), 17, 1.18281, 0.447428), 25, 0.145504))
        for run in (turns.bm25(wider, 20, 1.02941, 0.481409), turns.bm25(fed, 20, 1.18281, 0.447428)):
            for n, (k, _) in enumerate(run, 1):
                want[topic, k] += 1 / (60 + n)
    got = {(r.topic, r.doc_id): r.score for r in registry.queries()["feedback_fusion"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(got) > 40


def test_stems_in_sql():
    """The stemmer of the oracles is the stemmer of the engine."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(5)
    ends = ["", "s", "ies", "sses", "ed", "eed", "ing", "y", "e", "ll", *(a for a, _ in tx._STEP2 + tx._STEP3), *tx._STEP4]
    said = {"".join(rng.choices("aeiouybcdlstwxz", k=rng.randint(0, 6))) + rng.choice(ends) + rng.choice(ends[:10]) for _ in range(5000)} - {""} | {"a1ing", "sky", "syzygy"}
    rows = "SELECT unnest([" + ", ".join(f"'{w}'" for w in sorted(said)) + "]) AS term"
    assert dict(duckdb.sql(f"WITH {stems_sql(rows)} SELECT term, stem FROM fam").fetchall()) == {w: stem(w) for w in said}
