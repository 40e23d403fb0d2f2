"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed. The input acceptor spells a conversation's rows in order, each with its role's
initial and its first fault. The edit transducer keeps a row, gives it another role, deletes it, or inserts an empty row,
each at a cost. The role grammar is an acceptor of the initials of a well-formed conversation. A state
of the composition is (row, grammar state); its arcs are made when it is reached, and as rows only go
forward and inserted rows cost something, costs to the end are settled from the last row back. Weights are
(cost, labels) in lexicographic order: of all cheapest repairs the one whose labels come first in ASCII. Labels of the
arcs that leave a state differ, so the first label decides between equal costs, and the least labels
are found by taking, from the start, the first label that leads on a cheapest way.

A conversation of any length is worked on in blocks of ``BLOCK`` rows at once: the cheapest cost
from each state before a block to each behind it is a small matrix (min, +), a pass over these matrices from the last
to the first tells every block the costs behind it, and each block is then walked from each of its
possible first states. Only the digest of the repaired text is taken row after row, as its definition is.

Defined results: rows are ordered by turn (nulls first), then role, text, and equal rows stand side by side; a null
role or text is one space, as a null id is a conversation of its own; a role's initial is its first character, of an empty role
none, which no grammar accepts. A row's first fault counts: blank, else duplicate of an earlier row's role and text, else truncated.
Other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm._shared import arrow_map, materialize

#: Rows of a conversation that one step holds.
BLOCK = 4096
#: The white space of the contract, ends of sentences, faults.
SPACE, ENDS = " \t\n\x0b\f\r", ".!?"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
NEVER = 1 << 60
#: Row and cost patterns whose best arcs a task remembers.
KNOWN = 50_000


@dataclass(frozen=True)
class Machine:
    """The edit transducer and the role grammar: by default `(s?(ua)+)?` over initials, state 0 first."""

    arcs: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    accepting: frozenset[int] = frozenset({0, 3})
    written: dict[str, str] = field(default_factory=lambda: {"u": "user", "a": "assistant"})
    legal: frozenset[str] = frozenset({"su", "ua", "au"})
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1

    def __post_init__(self) -> None:
        if any(sum(r in out for r in self.written) > 1 for out in self.arcs):
            raise ValueError("two roles can be written in one state, so labels don't tell repairs apart")
        if self.insert <= 0:
            raise ValueError("inserted rows must cost something")

    def writes(self, state: int) -> str | None:
        """The role that can be written in a state."""
        return next((r for r in self.written if r in self.arcs[state]), None)

    def out(self, state: int, initial: str, fault: int) -> Iterator[tuple[int, str, int]]:
        """Arcs of the composition that read a row: (cost, label, state)."""
        yield self.delete, "D", state
        if fault in (BLANK, DUPLICATE):
            return
        more = self.truncated if fault == TRUNCATED else 0
        if initial in self.arcs[state]:
            yield more, "K", self.arcs[state][initial]
        role = self.writes(state)
        if role:
            yield self.rerole + more, "R", self.arcs[state][role]

    def inserting(self, way: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        """Best (cost, label, state) of each state, when rows may be inserted first."""
        best = list(way)
        while True:
            again = [(best[t][0] + self.insert, "I", t) if (r := self.writes(q)) and (t := self.arcs[q][r]) is not None else (NEVER, "I", q) for q in range(len(best))]
            after = [min(a, b, key=lambda x: x[:2]) for a, b in zip(best, again, strict=True)]
            if [x[:2] for x in after] == [x[:2] for x in best]:
                return after
            best = after

    def end(self) -> list[tuple[int, str, int]]:
        """Best way on from each state behind the last row."""
        return self.inserting([(0 if q in self.accepting else NEVER, "", q) for q in range(len(self.arcs))])

    def back(self, rows: list[tuple[str, int]], behind: list[int], known: dict | None = None) -> list[list[tuple[int, str, int]]]:
        """For each row and state the best (cost, label, state) before it, given the costs behind the last. ``known`` keeps
        what was found for other conversations; it starts anew at ``KNOWN`` entries."""
        ways, costs = [], behind
        states = range(len(self.arcs))
        known = {} if known is None else known
        if len(known) > KNOWN:
            known.clear()
        for row in reversed(rows):
            # the same row before the same costs, but for a constant, has the same best arcs
            low = min(costs)
            key = (row, *(c - low for c in costs))
            found = known.get(key)
            if found is None:
                arcs = [min(((c + costs[t] - low, label, t) for c, label, t in self.out(q, *row)), key=lambda x: x[:2]) for q in states]
                found = known[key] = self.inserting(arcs)
            if low:
                found = [(min(c + low, NEVER), label, t) for c, label, t in found]
            ways.append(found)
            costs = [x[0] for x in found]
        return ways[::-1]

    def matrix(self, rows: list[tuple[str, int]], known: dict | None = None) -> list[int]:
        """Cheapest cost from each state before the rows to each behind them, by rows of the first."""
        n = len(self.arcs)
        to = [[w[0] for w in self.back(rows, [0 if q == x else NEVER for q in range(n)], known)[0]] for x in range(n)]
        return [min(to[x][q], NEVER) for q in range(n) for x in range(n)]

    def walk(self, ways: list[list[tuple[int, str, int]]], state: int) -> tuple[list[str], int]:
        """For each row what is done on the best way from ``state``, and the last state. In these codes a small
        letter is an inserted role, K a kept row, D a deleted one, a capital another role that it gets."""
        codes = []
        for way in ways:
            code = ""
            while True:
                _, label, to = way[state]
                role = self.writes(state)
                code += role if label == "I" else role.upper() if label == "R" else label
                state = to
                if label != "I":
                    break
            codes.append(code)
        return codes, state

    def tail(self, state: int) -> str:
        """The roles inserted behind the last row."""
        code = ""
        end = self.end()
        while end[state][1] == "I":
            code += self.writes(state)
            state = end[state][2]
        return code


def rows_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with nulls in place: conv tells a null id from all others."""
    named = F.coalesce(F.concat(F.lit("v"), F.col(conv_col).cast("string")), F.lit("n"))
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return conversations.select(named.alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults of the contract, by the checksum of conversation and turn: 0 of 20 drops a row, 1 empties it, 2 takes
    its ends of sentences, 3 repeats it, 4 makes it the user's."""
    conv = F.when(F.col("conv") == "n", " ").otherwise(F.expr("substring(conv, 2)"))
    kind = F.crc32(F.concat(conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    hit = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return hit.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def sound(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last character that is no space ends a sentence."""
    said = F.rtrim(text, F.lit(SPACE))
    return said == "", F.right(said, F.lit(1)).isin(*ENDS)


class Repairs:
    """The repairs of all conversations of ``rows`` (conv, turn, role, text).

    The rows are written once in order; ``summary`` and ``rows`` read what is written.
    """

    def __init__(self, rows: DataFrame, machine: Machine | None = None) -> None:
        self.machine = machine = machine or Machine()
        equal = rows.withColumn("lexspan_row", F.monotonically_increasing_id())  # lets a group of equal rows be split
        ordered = equal.orderBy("conv", F.asc_nulls_first("turn"), "role", "text", "lexspan_row").drop("lexspan_row")
        blank, ended = sound(F.col("text"))
        marked = ordered.withColumns({"pos": F.monotonically_increasing_id(), "name": F.sha2("text", 256), "blank": blank, "ended": ended})
        self.written = written = materialize(marked, "conversation-rows")
        first = written.groupBy("conv", "role", "name").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
        fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(SOUND)
        slim = written.select("conv", "pos", "blank", "ended", F.substring("role", 1, 1).alias("initial")).join(first, "pos", "left")
        part = F.struct(F.shiftright("pos", 33), F.floor(F.col("pos").bitwiseAND((1 << 33) - 1) / BLOCK))
        grouped = slim.groupBy("conv", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "initial", fault.alias("fault")))).alias("rows"))
        blocks = grouped.select("conv", F.col("rows")[0]["pos"].alias("pos"), F.col("rows.initial").alias("initials"), F.col("rows.fault").alias("faults"))
        self.blocks = materialize(self._measured(blocks), "conversation-blocks")
        self.walked = materialize(self._walked(self._behind()), "conversation-walks")

    def _measured(self, blocks: DataFrame) -> DataFrame:
        """Blocks with their matrix and the pairs of initials inside that the grammar's pairs don't hold."""
        machine = self.machine

        def run(batches):
            known: dict = {}
            for batch in batches:
                made = [(machine.matrix([*zip(i, f, strict=True)], known), sum(a + b not in machine.legal for a, b in zip(i, i[1:], strict=False))) for i, f in zip(batch.column("initials").to_pylist(), batch.column("faults").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m for m, _ in made], pa.list_(pa.int64())), pa.array([n for _, n in made], pa.int64())], [*batch.schema.names, "matrix", "illegal"])

        return arrow_map(blocks, run, "conv string, pos long, initials array<string>, faults array<int>, matrix array<long>, illegal long")

    def _behind(self) -> DataFrame:
        """(pos, behind): the costs behind each block, carried from a conversation's last block to its first."""
        machine, n = self.machine, len(self.machine.arcs)
        last_first = self.blocks.select("conv", "pos", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("pos"))

        def run(batches):
            of, costs = None, []
            for batch in batches:
                told = []
                for conv, matrix in zip(batch.column("conv").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                    if conv != of:
                        of, costs = conv, [x[0] for x in machine.end()]
                    told.append(costs)
                    costs = [min(min(matrix[q * n + x] + costs[x] for x in range(n)), NEVER) for q in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column("pos"), pa.array(told, pa.list_(pa.int64()))], ["pos", "behind"])

        return arrow_map(last_first, run, "pos long, behind array<long>")

    def _walked(self, behind: DataFrame) -> DataFrame:
        """Blocks with the best way from each first state: what it does to each row, and its last state."""
        machine = self.machine
        names = ["conv", "pos", "codes", "exits", "cost", "faults", "first", "last", "illegal"]

        def run(batches):
            known: dict = {}
            for batch in batches:
                made = []
                for row in batch.to_pylist():
                    ways = machine.back([*zip(row["initials"], row["faults"], strict=True)], row["behind"], known)
                    walks = [machine.walk(ways, q) if ways[0][q][0] < NEVER else (["D"] * len(ways), q) for q in range(len(machine.arcs))]
                    counts = [row["faults"].count(k) for k in (BLANK, DUPLICATE, TRUNCATED)]
                    made.append((row["conv"], row["pos"], [",".join(c) for c, _ in walks], [q for _, q in walks], ways[0][0][0], counts, row["initials"][0], row["initials"][-1], row["illegal"]))
                yield pa.RecordBatch.from_pylist([dict(zip(names, m, strict=True)) for m in made], WALKS)

        return arrow_map(self.blocks.join(behind, "pos").select("conv", "pos", "initials", "faults", "illegal", "behind"), run, WALKS_SQL)

    def _told(self, make, schema: str) -> DataFrame:
        """All rows of each conversation in order, each block's ways before its rows, through ``make``: one pass
        that holds one Arrow batch and what ``make`` carries."""
        w = self.walked.select("conv", "pos", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.struct("codes", "exits", "cost", "faults", "first", "last", "illegal").alias("block"))
        r = self.written.select("conv", "pos", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast(w.schema["block"].dataType).alias("block"))
        ordered = w.unionByName(r).repartition("conv").sortWithinPartitions("conv", "pos", "kind")

        def run(batches):
            conversation = None
            for batch in batches:
                told = []
                for row in batch.to_pylist():
                    if conversation is None or row["conv"] != conversation.conv:
                        if conversation is not None:
                            told += conversation.close()
                        conversation = make(row["conv"])
                    told += conversation.block(row["block"]) if row["kind"] == 0 else conversation.row(row)
                if told:
                    yield from batched(told, conversation.schema)
            if conversation is not None:
                yield from batched(conversation.close(), conversation.schema)

        return arrow_map(ordered, run, schema)

    def summary(self) -> DataFrame:
        """(conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation with rows. ``audit`` has
        a letter for each edit: K keep, R other role, D delete, I insert."""
        machine = self.machine
        return self._told(lambda conv: Digest(machine, conv), "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def rows(self) -> DataFrame:
        """(conv, pos, sub, edit, role, text): the repaired conversations, in order of pos and sub. ``edit`` is K, R or I."""
        machine = self.machine
        return self._told(lambda conv: Rewrite(machine, conv), "conv string, pos long, sub int, edit string, role string, text string")


WALKS_SQL = "conv string, pos long, codes array<string>, exits array<int>, cost long, faults array<long>, first string, last string, illegal long"
WALKS = pa.schema(
    [
        ("conv", pa.string()), ("pos", pa.int64()), ("codes", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())), ("cost", pa.int64()),
        ("faults", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()),
    ]
)


def batched(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Told:
    """One conversation, told block by block and row by row."""

    def __init__(self, machine: Machine, conv: str) -> None:
        self.machine, self.conv, self.state = machine, conv, 0
        self.codes: Iterator[str] = iter(())

    def block(self, block: dict) -> list[tuple]:
        self.codes = iter(block["codes"][self.state].split(","))
        self.state = block["exits"][self.state]
        return []

    def lines(self, code: str, row: dict | None) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what a code leaves of a row, and of what it inserts before it."""
        written = self.machine.written
        for c in code:
            if c in written:
                yield "I", written[c], ""
            elif c == "K":
                yield "K", row["role"], row["text"]
            elif c != "D":
                yield "R", written[c.lower()], row["text"]


class Digest(Told):
    schema = pa.schema([("conv", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def __init__(self, machine: Machine, conv: str) -> None:
        super().__init__(machine, conv)
        self.counts, self.illegal, self.cost, self.last = [0, 0, 0], 0, None, None
        self.audit, self.sha, self.begun = [], hashlib.sha256(), False
        self.labels = {ord(c): "I" for c in machine.written} | {ord(c.upper()): "R" for c in machine.written}

    def block(self, block: dict) -> list[tuple]:
        if self.cost is None:
            self.cost = block["cost"]
        self.audit.append(block["codes"][self.state].replace(",", "").translate(self.labels))
        self.counts = [a + b for a, b in zip(self.counts, block["faults"], strict=True)]
        self.illegal += block["illegal"] + (self.last is not None and self.last + block["first"] not in self.machine.legal)
        self.last = block["last"]
        return super().block(block)

    def add(self, code: str, row: dict | None) -> None:
        for _, role, text in self.lines(code, row):
            self.sha.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.begun = True

    def row(self, row: dict) -> list[tuple]:
        self.add(next(self.codes), row)
        return []

    def close(self) -> list[tuple]:
        tail = self.machine.tail(self.state)
        self.add(tail, None)
        return [(self.conv, *self.counts, self.illegal, self.cost, "".join(self.audit) + "I" * len(tail), self.sha.hexdigest())]


class Rewrite(Told):
    schema = pa.schema([("conv", pa.string()), ("pos", pa.int64()), ("sub", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    pos, sub = -1, 0

    def row(self, row: dict) -> list[tuple]:
        found = [(self.conv, row["pos"], k, *line) for k, line in enumerate(self.lines(next(self.codes), row))]
        self.pos, self.sub = row["pos"], len(found)
        return found

    def close(self) -> list[tuple]:
        return [(self.conv, self.pos, self.sub + k, *line) for k, line in enumerate(self.lines(self.machine.tail(self.state), None))]


def gaps(rows: DataFrame) -> DataFrame:
    """(conv, gaps): turns missing between the least and the greatest; null turns don't count."""
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    return rows.groupBy("conv").agg(span.alias("gaps"))


def report(conversations: DataFrame, damage: bool = False, machine: Machine | None = None) -> DataFrame:
    """One row for each conversation id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``damage`` puts the contract's faults into the rows first; a conversation that keeps no row has zeros, no edit, and the
    digest of nothing.
    """
    found = rows_of(conversations)
    ids = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")))
    found = damaged(found) if damage else found
    repairs = Repairs(found, machine)
    told = ids.join(repairs.summary(), "conv", "left").join(gaps(repairs.written), "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return told.select(
        "conv_id", *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
