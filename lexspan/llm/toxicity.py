"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Tokens are words and the beginnings of words, which stand for their inflections. Each has the log-odds
of its document frequency in toxic against other training documents, with an informative Dirichlet
prior in proportion to its overall frequency; a word takes the score of its most telling token. Words
without a significant ratio, and unseen ones, count against a passage. One linear pass over the scores of a
document finds all maximal-scoring segments. Chance segments of a text of n tokens follow an
extreme-value law: K n exp(-lambda S) of them are expected to reach S. Lambda is solved from the scores under
clean text, K is the maximum-likelihood estimate from the best segments of clean training rows set aside. Segments below a level of significance are toxic passages; the evidence of a
document is the sum over its passages of lambda S - ln(K n), and a logistic fit on rows set aside
turns it into a probability.

Null and empty texts have no passage and no evidence. Without a toxic training row the score is 0. Repeated
rows get equal scores, a score of exactly 0.5 counts as toxic, an empty table gives an empty one, and a column of the
table with the name of a result gives way to it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm._shared import append_columns, arrow_map
from lexspan.llm.labelled import training_rows

WORD = re.compile(r"[^\W_]+")
#: Lengths of the beginnings that are tokens of a longer word.
STEMS = (4, 5, 6)
PASSAGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])


def tokens(word: str) -> list[str]:
    """The word and its beginnings, these marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if n < len(word))]


@dataclass(frozen=True)
class ToxicModel:
    """Scores of the tokens that differ from ``neutral``, and the calibration."""

    weights: dict[str, float]
    neutral: float
    decay: float  # lambda
    scale: float  # ln K
    level: float
    slope: float
    offset: float

    def word_score(self, word: str) -> float:
        """That of the token which differs most from ``neutral``; on a tie the higher."""
        return max((self.weights.get(t, self.neutral) for t in tokens(word)), key=lambda w: (abs(w - self.neutral), w))

    def scored(self, words: list[str]) -> list[tuple[int, float]]:
        """The places and scores of words that aren't neutral."""
        known = self.weights.keys()
        return [(k, w) for k, word in enumerate(words) if (word in known or word[:4] + "*" in known or word[:5] + "*" in known or word[:6] + "*" in known) and (w := self.word_score(word)) != self.neutral]

    def best(self, text: str) -> tuple[int, float]:
        """The number of words and the score of the best segment, 0 if there is none above."""
        words = WORD.findall(text.lower())
        return len(words), max((s for *_, s in maximal_segments(self.scored(words), self.neutral)), default=0.0)

    def segments(self, text: str) -> tuple[list[tuple[int, int, float, float]], float]:
        """Significant passages (first and past-the-last code point, score, expected number by
        chance), and the evidence of the whole text."""
        low = text.lower()
        words = WORD.findall(low)
        scored = self.scored(words)
        if not any(w > 0 for _, w in scored):
            return [], 0.0
        found, evidence, spots = [], 0.0, None
        room = self.scale + math.log(len(words))
        for first, last, score in maximal_segments(scored, self.neutral):
            gain = self.decay * score - room
            if -gain <= math.log(self.level):
                if len(low) != len(text):  # lower-casing may add characters: find the words in the text itself
                    spots = spots or [m.span() for m in WORD.finditer(text)]
                spots = spots or [m.span() for m in WORD.finditer(low)]
                if last < len(spots):
                    found.append((spots[first][0], spots[last][1], score, math.exp(-gain)))
                evidence += gain
        return found, evidence

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * evidence))))


def maximal_segments(scored: list[tuple[int, float]], neutral: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a score sequence in one pass; ``scored`` has the places and
    scores that aren't ``neutral`` (below 0). Returns (first, last, score), first to last.

    Each candidate keeps the cumulative score before and after it. A new positive score either joins
    the nearest earlier candidate that starts lower and ends lower, with all between, or stands alone.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, at = 0.0, 0
    for k, w in scored:
        total += neutral * (k - at)
        at = k + 1
        before, total = total, total + w
        if w <= 0:
            continue
        first, low = k, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                stack.append((first, k, low, total))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high in stack]


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, toxic, clean): in how many training documents of each kind each token stands."""

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in {t for word in set(WORD.findall(text.lower())) for t in tokens(word)}:
                    counts.setdefault(w, [0, 0])[0 if y else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["token", "toxic", "clean"])

    parts = arrow_map(rows.select(F.col("y").cast("int").alias("y"), "text"), run, "token string, toxic long, clean long")
    return parts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratios with a Dirichlet prior of total mass ``prior`` (and half a count a token), and
    their significance: signed roots of likelihood ratios, which rare tokens can't inflate."""
    share = prior * (toxic + clean) / max(all_toxic + all_clean, 1) + 0.5
    a, b = toxic + share, clean + share
    ratio = np.log(a / (all_toxic + prior - a).clip(0.5)) - np.log(b / (all_clean + prior - b).clip(0.5))
    part = all_toxic / max(all_toxic + all_clean, 1)
    expected = ((toxic + clean) * part, (toxic + clean) * (1 - part))
    g = 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0) for o, e in zip((toxic, clean), expected, strict=True))
    return ratio, np.sign(toxic - expected[0]) * np.sqrt(g.clip(0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 5, out: int = 0, most: int = 10_000, vocabulary: int = 150_000, prior: float = 500.0, z: float = 5.0, neutral: float = -0.5, level: float = 0.001, text_col: str = "text") -> ToxicModel:
    """Learn from at most ``most`` labelled rows; ``vocabulary`` bounds the tokens that come to the driver
    (those in the most training documents, 3 at least)."""
    rows = training_rows(docs, labels, label, mod, out, most, text_col)
    counts = token_counts(rows.where("part < 8"))
    totals = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    all_toxic, all_clean = (float(x or 0) for x in totals)
    if not all_toxic:
        return ToxicModel({}, neutral, 1.0, 0.0, level, 0.0, -30.0)
    top = counts.where("toxic + clean >= 3").orderBy((F.col("toxic") + F.col("clean")).desc(), "token").limit(vocabulary).toPandas()
    toxic, clean = top["toxic"].to_numpy(float), top["clean"].to_numpy(float)
    ratio, sure = log_odds(toxic, clean, all_toxic, all_clean, prior)
    score = np.where(sure >= z, ratio, np.minimum(ratio, 0).clip(-2) * (sure <= -z)) + neutral
    weights = {w: float(s) for w, s, r in zip(top["token"], score, sure, strict=True) if abs(r) >= z}
    share = (clean + 0.01) / (all_clean + 0.01 * len(clean))
    decay = solve_decay(score, share * (abs(sure) >= z), neutral)
    aside = rows.where("part >= 8").select("y", "text")
    draft = ToxicModel(weights, neutral, decay, 0.0, level, 1.0, 0.0)
    fields = [T.StructField("n", T.IntegerType()), T.StructField("best", T.DoubleType())]
    best = append_columns(aside.where("y = 0"), "text", fields, lambda: lambda texts: [pa.array(c, k) for c, k in zip(zip(*map(draft.best, texts.to_pylist()), strict=True), (pa.int32(), pa.float64()), strict=True)])
    clean_best = best.where("n > 0").select("n", "best").toPandas()  # at most ``most`` rows
    scale = fit_scale(clean_best["n"].to_numpy(float), clean_best["best"].to_numpy(float), decay)
    model = ToxicModel(weights, neutral, decay, scale, level, 1.0, 0.0)
    evidence = append_columns(aside, "text", [T.StructField("evidence", T.DoubleType())], lambda: lambda texts: [pa.array([model.segments(t)[1] for t in texts.to_pylist()], pa.float64())])
    told = evidence.select(F.col("y").cast("double").alias("y"), "evidence").toPandas()
    slope, offset = logistic(told["evidence"].to_numpy(), (told["y"] > 0).to_numpy(float))
    return ToxicModel(weights, neutral, decay, scale, level, slope, offset)


def fit_scale(n: np.ndarray, best: np.ndarray, decay: float) -> float:
    """ln K by maximum likelihood under P(best < S) = exp(-K n exp(-decay S)). Texts without a segment are
    known to be below the least score seen; with no segment at all K is that of half a one there."""
    seen = best > 0
    floor = best[seen].min() if seen.any() else 1.0
    mass = float((n * np.exp(-decay * np.where(seen, best, floor))).sum())
    return math.log(max(float(seen.sum()), 0.5) / mass) if mass else 0.0


def solve_decay(score: np.ndarray, share: np.ndarray, neutral: float) -> float:
    """The positive root of sum(share exp(x score)) = 1, all other mass at ``neutral``."""
    rest = max(0.0, 1 - share.sum())

    def above(x: float) -> bool:
        return float((share * np.exp(np.minimum(x * score, 700))).sum() + rest * math.exp(x * neutral)) > 1

    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if above(mid) else (mid, high)
    return low


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a one-dimensional logistic fit by Newton steps, x on a log scale inside 0..40."""
    x = np.clip(x, 0, 40)
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return max(float(w[0]), 1e-3), float(w[1])


def score_documents(docs: DataFrame, model: ToxicModel, text_col: str = "text", score_col: str = "toxicity", passages_col: str = "toxic_passages") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic, and its toxic passages
    (code points, end exclusive, score, number expected by chance)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ``vocabulary``

    def make():
        m = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            scores, rows = [], []
            for text in texts.to_pylist():
                found, evidence = m.segments(text or "")
                scores.append(m.probability(min(evidence, 40.0)))
                rows.append([dict(zip(("start", "end", "score", "expected"), f, strict=True)) for f in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
            return [pa.array(scores, pa.float64()), pa.array(rows, kind)]

        return work

    return append_columns(docs, text_col, [T.StructField(score_col, T.DoubleType()), T.StructField(passages_col, T.ArrayType(PASSAGE))], make)
