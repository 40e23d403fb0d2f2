"""The interval language: expressions, their two notations, rewrites, and lowering to DataFrames.

The prefix notation is ``(op expr ...)`` with the operators of ``OPERATORS``; a term is a raw word or
quoted by ``"``, ``'`` or a backtick. The infix notation has no precedence and associates to the left.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import STOPWORDS, porter
from lexspan.operators import intervals as iv
from lexspan.operators.intervals import GclError

#: Operator tokens, the first of each line is printed.
OPERATORS = {
    "^": "^", "all_of": "^", "and": "^",
    "+": "+", "one_of": "+", "or": "+",
    "...": "...", "<>": "...", "followed_by": "...",
    "<<": "<<", "contained_in": "<<",
    ">>": ">>", "containing": ">>",
    "!<": "!<", "not_contained_in": "!<",
    "!>": "!>", "not_containing": "!>",
    "@": "@", "link": "@",
    "%": "%", "materialize": "%",
}
NEED_TWO = {"<<", ">>", "!<", "!>"}


@dataclass(frozen=True)
class Term:
    text: str
    quote: str = ""

    def __str__(self) -> str:
        return quoted(self.text) if self.quote else self.text


@dataclass(frozen=True)
class Width:
    n: int

    def __str__(self) -> str:
        return f"(# {self.n})"


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple[Expr, ...]

    def __str__(self) -> str:
        return f"({self.op} {' '.join(map(str, self.args))})"


Expr = Term | Width | Node


def quoted(text: str) -> str:
    """A term in double quotes, its quotes and backslashes escaped."""
    return '"' + re.sub(r'(["\\])', r"\\\1", text) + '"'


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self) -> GclError:
        return GclError(f"parse error at offset {self.at}:{self.text}")

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t":
            self.at += 1

    def word(self) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in " \t()":
            self.at += 1
        if start == self.at:
            raise self.fail()
        return self.text[start : self.at]

    def expression(self) -> Expr:
        self.space()
        if self.at >= len(self.text):
            raise self.fail()
        c = self.text[self.at]
        if c == "(":
            return self.node()
        if c in "\"'`":
            return self.quoted(c)
        return Term(self.word())

    def quoted(self, mark: str) -> Term:
        self.at += 1
        out = []
        while self.at < len(self.text) and self.text[self.at] != mark:
            if self.text[self.at] == "\\" and self.at + 1 < len(self.text):
                self.at += 1
            out.append(self.text[self.at])
            self.at += 1
        if self.at >= len(self.text):
            raise self.fail()
        self.at += 1
        text = "".join(out)
        # only double quotes make a phrase; the other marks stay part of the term
        return Term(text, mark) if mark == '"' else Term(f"{mark}{text}{mark}")

    def node(self) -> Expr:
        self.at += 1
        self.space()
        start = self.at
        name = self.word()
        if name == "#":
            self.space()
            digits = self.word()
            if not digits.isdigit():
                raise self.fail()
            made: Expr = Width(int(digits))
            self.space()
        elif name in OPERATORS:
            args = []
            self.space()
            while self.at < len(self.text) and self.text[self.at] != ")":
                args.append(self.expression())
                self.space()
            op = OPERATORS[name]
            if len(args) < (2 if op in NEED_TWO else 1) or (op in "@%" and len(args) > 1):
                raise self.fail()
            made = Node(op, tuple(args))
        else:
            self.at = start
            raise self.fail()
        if self.at >= len(self.text) or self.text[self.at] != ")":
            raise self.fail()
        self.at += 1
        return made


def parse(text: str) -> Expr:
    """The expression at the start of ``text`` in prefix notation; what follows it is ignored."""
    return _Reader(text).expression()


# Infix notation

#: Infix operators and what they become.
INFIX = {">": ">>", ">>": ">>", "containing": ">>", "<": "<<", "<<": "<<", "contained in": "<<", "/>": "!>", "not containing": "!>", "/<": "!<", "not contained in": "!<", "^": "^", "and": "^", "+": "+", "or": "+", "<>": "...", "..": "...", "...": "...", "....": "..."}
_LEX = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|(not\s+contained\s+in|not\s+containing|contained\s+in|containing)\b|(\.{2,4}|<>|>>|<<|/>|/<|[>^+<=(),\[\]])|([A-Za-z0-9_]+))')


class Infix:
    """Reads infix expressions; ``name = expression`` defines a macro for later lines."""

    def __init__(self, real_n_of: bool = False) -> None:
        self.macros: dict[str, Expr] = {}
        self.real_n_of = real_n_of

    def read(self, text: str) -> Expr | None:
        """The expression, or None for a definition."""
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                self.items.append(("bad", text[at:].strip()))
                break
            at = m.end()
            for kind, value in zip(("quoted", "op", "sign", "word"), m.groups(), strict=True):
                if value is not None:
                    self.items.append((kind, re.sub(r"\s+", " ", value) if kind == "op" else value))
        self.at = 0
        if len(self.items) > 2 and self.items[0][0] == "word" and self.items[1] == ("sign", "="):
            self.at = 2
            self.macros[self.items[0][1]] = self._whole()
            return None
        return self._whole()

    def _peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def _take(self, value: str, message: str) -> None:
        if self._peek()[1] != value:
            raise GclError(message)
        self.at += 1

    def _whole(self) -> Expr:
        made = self._chain()
        if self._peek()[0] != "end":
            raise GclError("Syntax error.")
        return made

    def _chain(self) -> Expr:
        left = self._operand()
        while self._peek()[1].lower() in INFIX and self._peek()[0] != "quoted":
            op = INFIX[self._peek()[1].lower()]
            self.at += 1
            left = Node(op, (left, self._operand()))
        return left

    def _operand(self) -> Expr:
        kind, value = self._peek()
        self.at += 1
        if kind == "quoted":
            return Term(re.sub(r"\\(.)", r"\1", value[1:-1]), '"')
        if value == "(":
            made = self._chain()
            self._take(")", 'Missing ")".')
            return made
        if value == "[":
            n = self._number()
            self._take("]", 'Missing "]".')
            return Width(n)
        if kind == "word":
            if value in ("one", "all"):
                if self._peek()[1] not in ("of", "^"):
                    raise GclError(f'Expected "^" or "of" after "{value}".')
                return self._n_of(value)
            if value.isdigit():
                if self._peek()[1] == "words":
                    self.at += 1
                    if int(value) == 0:
                        raise GclError("Zero width.")
                    return Width(int(value))
                return self._n_of(value)
            if value in self.macros:
                return self.macros[value]
        raise GclError("Undefined symbol.")

    def _number(self) -> int:
        kind, value = self._peek()
        if not value.isdigit() or int(value) == 0:
            raise GclError("Expected a number.")
        self.at += 1
        return int(value)

    def _n_of(self, count: str) -> Expr:
        self.at += 1
        self._take("(", 'Missing "(" after start of combination operator.')
        args = [self._chain()]
        while self._peek()[1] == ",":
            self.at += 1
            args.append(self._chain())
        self._take(")", 'Missing ")".')
        args.reverse()
        n = {"one": 1, "all": len(args)}.get(count) if not count.isdigit() else int(count)
        if n > len(args):
            raise GclError("Too few elements on right-hand side of combination operator.")
        if n == 0:
            return Width(1)
        if n == len(args) and n > 1:
            return Node("^", tuple(args))
        if n == 1:
            return Node("+", tuple(args))
        if self.real_n_of:
            return Node("+", tuple(Node("^", c) for c in itertools.combinations(args, n)))
        return Node(str(n), tuple(args))


def compile_program(text: str) -> tuple[list[tuple[str, Expr]], list[str]]:
    """Tiers (name, expression) of a program of definitions with one ``@rank`` line, and all diagnostics."""
    reader, tiers, errors = Infix(), [], []
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith(("#", ";;")):
            continue
        if line.startswith("@rank"):
            for name in line.split()[1:]:
                if name.isdigit():
                    continue
                if name in reader.macros:
                    tiers.append((name, reader.macros[name]))
                else:
                    errors.append(f"TIER ERR {name}: Undefined symbol.")
            continue
        try:
            reader.read(line)
        except GclError as e:
            errors.append(f"DEF ERR line {n}: {e}")
    return tiers, errors


# Rewrites

def walk(expr: Expr) -> Iterator[Expr]:
    yield expr
    for arg in expr.args if isinstance(expr, Node) else ():
        yield from walk(arg)


def rewritten(expr: Expr, change: Callable[[Term], Expr]) -> Expr:
    """The expression with each term changed."""
    if isinstance(expr, Term):
        return change(expr)
    return Node(expr.op, tuple(rewritten(a, change) for a in expr.args)) if isinstance(expr, Node) else expr


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def leaves(expr: Expr) -> list[str]:
    """Distinct content terms, without tags, in order."""
    found = [w for x in walk(expr) if isinstance(x, Term) and not x.text.startswith(":") for w in ([x.text] if x.text.startswith("porter:") else words_of(x.text))]
    return list(dict.fromkeys(found))


def families(expr: Expr) -> Expr:
    """``word*`` finds all words of its stem; any other star is an error."""

    def change(t: Term) -> Expr:
        if "*" not in t.text:
            return t
        parts = t.text.split(" ")
        if any(("*" in w[:-1] or w == "*") for w in parts):
            raise GclError(f"family marker: {t.text}")
        return Term(" ".join("porter:" + porter(w[:-1].lower()) if w.endswith("*") else w for w in parts), t.quote)

    return rewritten(expr, change)


def stemmed(expr: Expr) -> Expr:
    """Every bare word by its stem; phrases stay."""
    return rewritten(expr, lambda t: t if " " in t.text or t.text.startswith(":") else Term("porter:" + s if (s := porter(t.text.lower())) != t.text.lower() else t.text, t.quote))


def optimized(expr: Expr) -> Expr:
    """Operators of one argument are the argument; nested ``^`` and ``+`` are one; containment under
    ``+`` is materialised, as it is read more than once."""
    if not isinstance(expr, Node):
        return expr
    args = tuple(optimized(a) for a in expr.args)
    if expr.op in ("^", "+", "...") and len(args) == 1:
        return args[0]
    if expr.op in ("^", "+"):
        args = tuple(x for a in args for x in (a.args if isinstance(a, Node) and a.op == expr.op else (a,)))
    if expr.op == "+":
        args = tuple(Node("%", (a,)) if isinstance(a, Node) and a.op in NEED_TWO else a for a in args)
    return Node(expr.op, args)


def any_of_words(text: str) -> list[str]:
    """Query words without stop words; all of them if nothing else is left."""
    terms = words_of(text)
    return [t for t in terms if t not in STOPWORDS] or terms


# Lowering

class Lowering:
    """Turns expressions into lists of intervals.

    ``leaf`` gives the list of a feature. ``places``, if given, has (term, doc_id, pos) of several terms from one scan, so the
    terms of a phrase, or those side by side under an operator, are read together. ``share`` writes a list
    that the expression uses more than once, so that it is made once; without it such a list is planned anew.
    """

    def __init__(self, leaf: Callable[[str], DataFrame], places: Callable[[list[str]], DataFrame] | None = None, share: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.leaf, self.places, self.share = leaf, places, share
        self.made: dict[Expr, DataFrame | int] = {}
        self.uses: Counter = Counter()

    def __call__(self, expr: Expr | str) -> DataFrame:
        expr = optimized(parse(expr) if isinstance(expr, str) else expr)
        self.uses = uses(expr)
        return self._list(self._lower(expr))

    def _lower(self, expr: Expr) -> DataFrame | int:
        expr = plain(expr)
        if expr not in self.made:
            made = self._make(expr)
            self.made[expr] = self.share(made) if self.share and self.uses[expr] > 1 and not isinstance(made, int) else made
        return self.made[expr]

    def _make(self, expr: Expr) -> DataFrame | int:
        if isinstance(expr, Width):
            return expr.n
        if isinstance(expr, Term):
            terms = self._words(expr)
            if not terms:
                return self.leaf(expr.text)
            if len(terms) == 1:
                return self.leaf(terms[0])
            return iv.phrase_sides(self._sided(tuple(Term(t) for t in terms)), len(terms))
        if expr.op.isdigit():
            raise GclError("n of m can't be evaluated in this notation")
        if expr.op == "@":
            return iv.link(self._list(self._lower(expr.args[0])))
        if expr.op in ("^", "+") and not any(isinstance(plain(a), Width) for a in expr.args):
            rows = self._sided(expr.args)
            return iv.all_of_sides(rows, len(expr.args)) if expr.op == "^" else iv.one_of_sides(rows)
        if len(expr.args) == 2 and expr.op in SIDED and not any(isinstance(plain(a), Width) for a in expr.args):
            return SIDED[expr.op](self._sided(expr.args))
        return reduce(lambda a, b: self._pair(expr.op, a, b), [self._lower(a) for a in expr.args])

    def _words(self, term: Term) -> list[str]:
        """The words of a term; none for a tag or annotation."""
        if term.text.startswith(":"):
            return []
        if "porter:" in term.text:
            return [w if w.startswith("porter:") else w.lower() for w in term.text.split()]
        return words_of(term.text)

    def _sided(self, args: tuple[Expr, ...]) -> DataFrame:
        """(doc_id, p, q, v, side): the lists of some arguments in one table; single words from one scan."""
        words = {i: w[0] for i, a in enumerate(args) if self.places and isinstance(plain(a), Term) and len(w := self._words(plain(a))) == 1}
        lists = []
        if words:
            sides = F.lit(None)
            for term in dict.fromkeys(words.values()):
                sides = F.when(F.col("term") == term, F.array(*[F.lit(i) for i, t in words.items() if t == term])).otherwise(sides)
            found = self.places(list(dict.fromkeys(words.values())))
            lists.append(found.select("doc_id", F.col("pos").alias("p"), F.col("pos").alias("q"), F.lit(0.0).alias("v"), F.explode(sides).alias("side")))
        for i, a in enumerate(args):
            if i not in words:
                lists.append(self._list(self._lower(a)).select(*iv.COLUMNS, F.lit(i).alias("side")))
        return reduce(DataFrame.unionByName, lists)

    def _list(self, made: DataFrame | int) -> DataFrame:
        if isinstance(made, int):
            raise GclError("windows without a list have no end")
        return made

    def _pair(self, op: str, a: DataFrame | int, b: DataFrame | int) -> DataFrame:
        if isinstance(a, int) and isinstance(b, int):
            raise GclError("windows without a list have no end")
        if isinstance(b, int):
            made = {">>": lambda: iv.longer(a, b), "!>": lambda: iv.longer(a, b, False), "<<": lambda: iv.shorter(a, b), "!<": lambda: iv.shorter(a, b, False), "...": lambda: iv.then_window(a, b), "^": lambda: iv.window_and(b, a)}.get(op)
        elif isinstance(a, int):
            made = {">>": lambda: iv.windows_containing(a, b), "<<": lambda: iv.windows_inside(a, b), "...": lambda: iv.window_then(a, b), "^": lambda: iv.window_and(a, b)}.get(op)
        else:
            made = {"^": lambda: iv.all_of(a, b), "+": lambda: iv.one_of(a, b), **{o: lambda f=f: f(iv._sides(a, b)) for o, f in SIDED.items()}}.get(op)
        if made is None:
            raise GclError("windows without a list have no end")
        return made()


#: Operators of two lists, from both in one table.
SIDED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "...": iv.followed_by_sides,
    "<<": iv.contained_in_sides,
    ">>": iv.containing_sides,
    "!<": lambda rows: iv.contained_in_sides(rows, False),
    "!>": lambda rows: iv.containing_sides(rows, False),
}


def uses(expr: Expr) -> Counter:
    """How many operators read each compound expression, what is inside a repeated one counted once."""
    found: Counter = Counter()
    todo = [expr]
    while todo:
        x = plain(todo.pop())
        if isinstance(x, Node):
            found[x] += 1
            if found[x] == 1:
                todo += x.args
    return found


def plain(expr: Expr) -> Expr:
    """An expression without a mark to materialise it: what is used twice is shared anyway."""
    while isinstance(expr, Node) and expr.op == "%":
        expr = expr.args[0]
    return expr
