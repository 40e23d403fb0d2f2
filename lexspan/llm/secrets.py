"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference builds a prefix tree over the character classes of labelled strings and merges
states whose outgoing and ending frequencies a Hoeffding bound finds compatible, with their whole
subtrees, which leaves a small probabilistic automaton for each label. A candidate, any run of
credential characters in a text, is scored by the log-likelihood ratio between the best credential
automaton and the automaton of ordinary strings. Every candidate of SHORTEST characters or more is scored,
whatever its characters and whether or not it touches a span of the fixed patterns; those that
reach the level are spans of the kind ``format``. Spans of the fixed patterns always stay.

Null and empty texts have no spans, texts of any length are read whole, repeated rows are scanned alike, an
empty table gives an empty one. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.llm._shared import append_columns, arrow_map, pieces

#: The patterns every scan has, in the order in which kinds are listed.
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
#: The shortest candidate; shorter runs hold too little for a likelihood to tell formats apart.
SHORTEST = 8
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
#: Candidates whose verdict a task remembers; at the bound it starts anew.
CACHE = 100_000
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def symbols(text: str) -> str:
    """Character classes: digits, letters a to f and the others in either case, signs as they are."""
    return text.translate(CLASSES)


CLASSES = {ord(c): k for k, chars in (("9", "0123456789"), ("a", "abcdef"), ("z", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"), ("Z", "GHIJKLMNOPQRSTUVWXYZ")) for c in chars}
ALPHABET = (*"9azAZ", *"+/_.=-")


def labelled_credentials(n: int = 400, seed: int = 17) -> list[tuple[str, str]]:
    """Labelled strings in published credential formats, and ordinary strings under the label ''.

    Deterministic, with invented values; callers with real labelled data pass their own.
    """
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed = lower + upper + digits

    def draw(chars: str, k: int) -> str:
        return "".join(rng.choice(chars) for _ in range(k))

    formats = {
        "access_key": lambda: rng.choice(["AKIA", "ASIA"]) + draw(upper + digits, 16),
        "hex_token": lambda: draw("abcdef" + digits, rng.choice([32, 40, 64])),
        "prefixed": lambda: rng.choice(["ghp_", "gho_", "glpat-", "sk-", "xoxb-"]) + draw(mixed, rng.choice([20, 32, 36, 48])),
        "base64_key": lambda: draw(mixed + "+/", rng.choice([40, 64, 86])) + rng.choice(["", "=", "=="]),
        "signed_token": lambda: "eyJ" + draw(mixed, 33) + ".eyJ" + draw(mixed, rng.randint(40, 90)) + "." + draw(mixed + "_-", 43),
    }
    word = lambda low=2, high=12: draw(lower, rng.randint(low, high))
    stop = lambda: rng.choice(["", "", "", ".", "...", "-", "/"])
    ordinary = [
        lambda: "".join(draw("aeiou", 1) + draw(lower, rng.randint(1, 2)) for _ in range(rng.randint(3, 12))) + stop(),
        lambda: word(8, 24) + stop(),
        lambda: word(8, 20).capitalize() + stop(),
        lambda: word(8, 20).upper() + stop(),
        lambda: "".join(word(2, 9).capitalize() for _ in range(rng.randint(2, 4))) + stop(),
        lambda: word(2, 8) + "".join(word(3, 9).capitalize() for _ in range(rng.randint(1, 3))),
        lambda: "-".join(word(2, 8) for _ in range(rng.randint(3, 6))) + stop(),
        lambda: ".".join(word(2, 9) for _ in range(rng.randint(3, 5))) + stop(),
        lambda: "/".join(word(2, 9) for _ in range(rng.randint(3, 6))) + draw(digits, rng.randint(0, 3)),
        lambda: word(3, 9) + "." + word(3, 9).capitalize(),
        lambda: word(5, 12) + draw(digits, rng.randint(1, 4)) + stop(),
        lambda: word(3, 10) + rng.choice("._-") + draw(digits, rng.randint(1, 4)),
        lambda: draw(upper, rng.randint(1, 3)) + word(5, 14) + stop(),
        lambda: f"{rng.randint(1900, 2090)}-{rng.randint(1, 12):02d}-{rng.randint(1, 31):02d}" + rng.choice(["", "/" + word(5, 12), "."]),
        lambda: "-".join(draw(digits, rng.randint(2, 4)) for _ in range(rng.randint(3, 4))) + stop(),
        lambda: ".".join(draw(digits, rng.randint(1, 3)) for _ in range(4)),
        lambda: "_".join(draw(upper, rng.randint(3, 8)) for _ in range(rng.randint(3, 5))),
        lambda: draw(digits, rng.randint(8, 24)) + stop(),
        lambda: rng.choice("=-_.+/") * rng.randint(8, 80),
    ]
    return [(kind, make()) for kind, make in formats.items() for _ in range(n)] + [("", make()) for make in ordinary for _ in range(n)]


@dataclass
class State:
    """Counts of what leaves and what ends here."""

    end: int = 0
    out: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return self.end + sum(self.out.values())


class Automaton:
    """A deterministic probabilistic automaton, inferred by merging compatible prefix-tree states."""

    def __init__(self, strings: Iterable[str], alpha: float = 0.05) -> None:
        self.states = [State()]
        for s in strings:
            at = 0
            for c in symbols(s):
                state = self.states[at]
                if c not in state.to:
                    self.states.append(State())
                    state.to[c], state.out[c] = len(self.states) - 1, 0
                state.out[c] += 1
                at = state.to[c]
            self.states[at].end += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        self.logs = [self._log_row(s) for s in self.states]

    def _infer(self) -> None:
        red, blue = [0], sorted(self.states[0].to.values())
        while blue:
            q = max(blue, key=lambda s: (self.states[s].total, -s))
            for r in red:
                if self._compatible(r, q):
                    for p in red:
                        for c, t in self.states[p].to.items():
                            if t == q:
                                self.states[p].to[c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
            blue = sorted({t for p in red for t in self.states[p].to.values()} - set(red))
        place = {s: k for k, s in enumerate(red)}
        self.states = [State(self.states[s].end, self.states[s].out, {c: place[t] for c, t in self.states[s].to.items()}) for s in red]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether all frequencies of two states, and of what follows them, may come from one source."""
        todo = [(a, b)]
        while todo:
            x, y = (self.states[s] for s in todo.pop())
            n, m = x.total, y.total
            if not n or not m:
                continue
            most = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(x.end / n - y.end / m) > most:
                return False
            for c in {*x.out, *y.out}:
                if abs(x.out.get(c, 0) / n - y.out.get(c, 0) / m) > most:
                    return False
                if c in x.to and c in y.to:
                    todo.append((x.to[c], y.to[c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree b to state a."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            x, y = self.states[p], self.states[q]
            x.end += y.end
            for c, n in y.out.items():
                x.out[c] = x.out.get(c, 0) + n
                if c not in x.to:
                    x.to[c] = y.to[c]
                elif x.to[c] != y.to[c]:
                    todo.append((x.to[c], y.to[c]))

    def _log_row(self, s: State) -> tuple[float, dict[str, float], float]:
        whole = s.total + 0.05 * (len(ALPHABET) + 1)
        return math.log((s.end + 0.05) / whole), {c: math.log((n + 0.05) / whole) for c, n in s.out.items()}, math.log(0.05 / whole)

    def log_likelihood(self, text: str) -> float:
        """Of the classes of a whole string; what a state has never seen leads back to the start."""
        total, at = 0.0, 0
        for c in symbols(text):
            _, out, unseen = self.logs[at]
            total += out.get(c, unseen)
            at = self.states[at].to.get(c, 0)
        return total + self.logs[at][0]


class FormatModel:
    """Automata of all labels of a labelled set; '' labels ordinary strings."""

    def __init__(self, labelled: Iterable[tuple[str, str]]) -> None:
        by: dict[str, list[str]] = {}
        for kind, text in labelled:
            by.setdefault(kind, []).append(text)
        self.ordinary = Automaton(by.pop("", ["a"]))
        self.formats = {kind: Automaton(strings) for kind, strings in by.items()}
        self.known: dict[str, float] = {}

    def score(self, text: str) -> float:
        """Log-likelihood ratio of the best format against ordinary strings."""
        if text not in self.known:
            if len(self.known) >= CACHE:
                self.known = {}
            best = max((a.log_likelihood(text) for a in self.formats.values()), default=-math.inf)
            self.known[text] = best - self.ordinary.log_likelihood(text)
        return self.known[text]


@lru_cache(maxsize=4)
def format_model(labelled: tuple[tuple[str, str], ...] | None) -> FormatModel:
    """One model for each worker process; None: ``labelled_credentials()``."""
    return FormatModel(labelled if labelled is not None else labelled_credentials())


def all_spans(text: str, model: FormatModel, least: float) -> list[tuple[str, int, int]]:
    """Base spans, and all candidates that a format explains better than ordinary text, by a log-likelihood
    ratio of ``least`` at least."""
    found = base_spans(text)
    found += [("format", m.start(), m.end()) for m in CANDIDATE.finditer(text) if model.score(m[0]) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def labelled_rows(rows: DataFrame, most: int = 20_000) -> tuple[tuple[str, str], ...]:
    """(kind, text) rows, such as a file of labelled strings, as the ``labelled`` of a scan; '' labels ordinary
    strings. At most ``most`` teach, those with the least hash; rows without a kind or text teach nothing."""
    some = rows.where("kind is not null and text <> ''").select("kind", "text").distinct()
    return tuple((r.kind, r.text) for r in some.orderBy(F.xxhash64("kind", "text"), "kind", "text").limit(most).collect())


def find_secrets(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans", labelled: tuple[tuple[str, str], ...] | None = None, least: float = 12.0) -> DataFrame:
    """``docs`` with all secret spans of each whole text, an array of (kind, start, end); a column of the table
    with that name gives way. ``least`` outweighs prior odds of one credential in exp(12), 160,000 candidates."""

    def make():
        model = format_model(labelled)

        def work(texts: pa.Array) -> list[pa.Array]:
            kinds, starts, stops, ends = [], [], [], [0]
            for text in texts.to_pylist():
                for kind, a, b in all_spans(text or "", model, least):
                    kinds.append(kind), starts.append(a), stops.append(b)
                ends.append(len(kinds))
            rows = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["kind", "start", "end"])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)]

        return work

    return append_columns(docs, text_col, [T.StructField(spans_col, T.ArrayType(SPAN))], make)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", labelled: tuple[tuple[str, str], ...] | None = None, least: float = 12.0) -> DataFrame:
    """``docs`` with every secret span (overlapping ones as one) replaced by ``mark``; texts without
    a span, null and empty ones included, stay as they are. Spans are found and cut in one pass."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        model = format_model(labelled)
        for batch in batches:
            for a, b in pieces(batch.column(at)):
                columns = batch.slice(a, b - a).columns
                columns[at] = pa.array([text and cut(text, all_spans(text, model, least), mark) for text in columns[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return arrow_map(docs, run, schema)


def cut(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with its spans, which are in order, replaced."""
    kept, at = [], 0
    for _, start, end in spans:
        if start >= at:
            kept += [text[at:start], mark]
        at = max(at, end)
    return "".join([*kept, text[at:]])


def digests(found: DataFrame, spans_col: str = "secret_spans") -> DataFrame:
    """doc_id with counts of the base kinds and the span lists as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans_col, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.filter(spans_col, lambda s: s["kind"] != "format")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col(spans_col)).alias("spans"),
    )
