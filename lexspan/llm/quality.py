"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network.

Random indexing: every word has a fixed sparse index vector of signs, drawn from its hash; the vector
of a word is the sum of the index vectors of its neighbours over all documents. Words are hashed into
``BUCKETS`` rows. Beside the word itself each place has a shape (letter case, digits, kinds of signs,
repetition), which has its own rows, so that unseen words say something too. Mean and spread of the
vectors of a text feed a network of two layers, trained with numpy on a bounded sample of labelled
rows; the logits are divided by a temperature fitted on rows set aside.

Null and empty texts have the vector 0 and get the probability that the network gives it. Repeated rows get equal
scores, a score of exactly 0.5 counts as label 1, an empty table gives an empty one, without labelled rows every score is
0.5, and a column of the table with the name of the result gives way to it.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm._shared import append_columns, arrow_map, pieces
from lexspan.llm.labelled import training_rows

PLACE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BUCKETS, SHAPES, WIDTH, SIGNS = 4096, 64, 32, 2
ROWS = BUCKETS + SHAPES
CACHE_WORDS = 100_000
FEATURES = 3 * WIDTH + 3


def shape(word: str) -> int:
    """One of the first SHAPES - 1 shapes: letters by case and length, digits, signs by their kind."""
    if word[0].isalpha():
        case = 0 if word.islower() else 1 if word.istitle() else 2 if word.isupper() else 3
        return case * 4 + min(3, len(word) // 4)
    if word[0].isdigit():
        return 16 + min(3, len(word) // 2)
    return 20 + zlib.crc32(word[:3].encode()) % 43


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each row's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, WIDTH, (ROWS, SIGNS)), rng.choice([-1.0, 1.0], (ROWS, SIGNS))


class Reader:
    """Turns texts into row numbers; remembers words up to CACHE_WORDS."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, shape rows and the end of each text; a word that repeats the one before it
        has the last shape."""
        cut = [PLACE.findall(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
            new = set().union(*cut)
        self.known.update((w, (zlib.crc32(w.lower().encode("utf-8", "replace")) % BUCKETS) << 8 | shape(w)) for w in new)
        get, counts = self.known.__getitem__, [len(c) for c in cut]
        both = np.fromiter((x for c in cut for x in map(get, c)), np.int64, sum(counts))
        words, shapes = both >> 8, BUCKETS + (both & 255)
        if len(words) > 1:
            shapes[1:][words[1:] == words[:-1]] = ROWS - 1
        return words, shapes, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def context_sums(docs: DataFrame, text_col: str, window: int = 2, seed: int = 5) -> np.ndarray:
    """Sums of the neighbours' index vectors for each row, over all documents: ROWS x WIDTH.

    Each task adds up its own share; what it sends and what reaches the driver is bounded by ROWS.
    """

    def run(batches):
        reader, (places, signs) = Reader(), index_vectors(seed)
        total = np.zeros(ROWS * WIDTH)
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                words, shapes, ends = reader.rows([t or "" for t in batch.column(0).slice(a, b - a).to_pylist()])
                text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                for step in range(1, window + 1):
                    same = text[step:] == text[:-step]
                    for own, near in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
                        for of, seen in ((words, words), (shapes, shapes), (words, shapes)):
                            target, source = of[own][same], seen[near][same]
                            for k in range(SIGNS):
                                total += np.bincount(target * WIDTH + places[source, k], signs[source, k], ROWS * WIDTH)
        table = total.reshape(ROWS, WIDTH).astype(np.float32)
        used = np.flatnonzero(np.abs(table).sum(1))
        flat = pa.array(table[used].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * WIDTH, pa.int32()), flat)], ["row", "v"])

    parts = arrow_map(docs.select(text_col), run, "row int, v array<float>")
    sums = parts.groupBy("row").agg(*[F.sum(F.col("v")[k].cast("double")).alias(f"v{k}") for k in range(WIDTH)]).toPandas()
    table = np.zeros((ROWS, WIDTH))
    table[sums["row"].to_numpy(int)] = sums[[f"v{k}" for k in range(WIDTH)]].to_numpy()
    return table


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    """Word vectors of length 1, less what all words have in common."""
    v = sums / np.linalg.norm(sums, axis=1, keepdims=True).clip(1e-9)
    used = np.abs(sums).sum(1) > 0
    v = np.where(used[:, None], v - v[used].mean(0) if used.any() else v, 0)
    return (v / np.linalg.norm(v, axis=1, keepdims=True).clip(1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, words: np.ndarray, shapes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FEATURES numbers for each text: means of word and shape vectors, spread of the words' vectors,
    log length, share of repeats, share of distinct words."""
    n = len(ends) - 1
    out = np.zeros((n, FEATURES), np.float32)
    size = np.diff(ends)
    for k in range(n):
        if not size[k]:
            continue
        w, s = words[ends[k] : ends[k + 1]], shapes[ends[k] : ends[k + 1]]
        # a text is its counts of rows: the vectors are pooled with these as weights
        rows, counts = np.unique(w, return_counts=True)
        share = counts / size[k]
        v = vectors[rows]
        mean = share @ v
        out[k, :WIDTH] = mean
        out[k, WIDTH : 2 * WIDTH] = (np.bincount(s - BUCKETS, minlength=SHAPES) / size[k]) @ vectors[BUCKETS:]
        out[k, 2 * WIDTH : 3 * WIDTH] = np.sqrt((share @ (v * v) - mean * mean).clip(0))
        out[k, -3:] = math.log1p(size[k]) / 10, (s == ROWS - 1).mean(), len(rows) / size[k]
    return out


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((features - self.centre) / self.spread @ w1 + b1, 0) @ w2 + b2

    def probability(self, features: np.ndarray) -> np.ndarray:
        """Rounded, as sums depend in their last digits on what stands beside a row in a batch."""
        return (1 / (1 + np.exp(-np.clip(self.logits(features.astype(float)) / self.temperature, -30, 30)))).round(10)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Two layers by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(2 / hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 128):
            rows = order[k : k + 128]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(d, p[2]) * (h > 0)
            grads = [x[rows].T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least logistic loss on rows set aside, on a grid of ratios."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(math.log(0.25), math.log(8), 61))
    return float(min(grid, key=lambda t: float(np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t).mean())))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, out: int = 1, most: int = 12_000, text_col: str = "text") -> QualityModel:
    """Word vectors from all documents, the network from at most ``most`` labelled rows."""
    vectors = unit_vectors(context_sums(docs, text_col))
    rows = training_rows(docs, labels, label, mod, out, most, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # ROWS x WIDTH

    def make():
        reader = Reader()

        def work(texts: pa.Array) -> list[pa.Array]:
            x = pooled(shared.value, *reader.rows([t or "" for t in texts.to_pylist()]))
            return [pa.array([r.tobytes() for r in x], pa.binary())]

        return work

    told = append_columns(rows.select("doc_id", "y", "part", "text"), "text", [T.StructField("x", T.BinaryType())], make).select("doc_id", "y", "part", "x").toPandas()
    told = told.sort_values(["doc_id", "x"], kind="stable")
    x = np.stack([np.frombuffer(b, np.float32) for b in told["x"]]).astype(float) if len(told) else np.zeros((0, FEATURES))
    y, part = (told["y"] > 0).to_numpy(float), told["part"].to_numpy(int)
    learn = part < 8
    if not learn.any():
        return QualityModel(vectors, np.zeros(FEATURES), np.ones(FEATURES), (np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0), 1.0)
    centre, spread = x[learn].mean(0), x[learn].std(0).clip(1e-3)
    model = QualityModel(vectors, centre, spread, train((x[learn] - centre) / spread, y[learn]), 1.0)
    return QualityModel(vectors, centre, spread, model.layers, fit_temperature(model.logits(x[~learn]), y[~learn]))


def score_documents(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with the probability that each whole text is of high quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        reader, m = Reader(), shared.value
        return lambda texts: [pa.array(m.probability(pooled(m.vectors, *reader.rows([t or "" for t in texts.to_pylist()]))).astype(float), pa.float64())]

    return append_columns(docs, text_col, [T.StructField(score_col, T.DoubleType())], make)
