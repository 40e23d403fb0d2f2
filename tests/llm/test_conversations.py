"""Conversation repair against brute force over whole label strings, with blocks, ties and odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from lexspan.llm import conversation_repair as repair
from lexspan.llm.queries import op12_conversation_repair

ROWS = "conv_id long, turn long, role string, text string, pos long, conv string, kind int"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SPACE = " \t\n\x0b\f\r"


def brute(rows):
    """Faults, cost, labels and text by trying every edit, with the labels as whole strings."""
    seen, faults = set(), []
    for role, text in rows:
        said = text.strip(SPACE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            (role, text), more = rows[i], int(faults[i] == "truncated")
            arcs = [(3, "D", state, ())]
            if faults[i] in ("", "truncated"):
                arcs += [(more, "K", NEXT[state][role[:1]], (f"{role}:{text}",))] if role[:1] in NEXT[state] else []
                arcs += [(2 + more, "R", NEXT[state][r[0]], (f"{r}:{text}",)) for r in ("user", "assistant") if r[0] in NEXT[state]]
            for cost, label, to, line in arcs:
                rest = best(i + 1, to, 0)
                found += [(cost + rest[0], label + rest[1], line + rest[2])] if rest else []
        for r in ("user", "assistant") if inserted < 3 else ():
            rest = best(i, NEXT[state][r[0]], inserted + 1) if r[0] in NEXT[state] else None
            found += [(2 + rest[0], "I" + rest[1], (f"{r}:", *rest[2]))] if rest else []
        return min(found, default=None)

    cost, labels, lines = best(0, 0, 0)
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(table):
    kept = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = {}
    for conv, rows in kept.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in rows if t is not None]
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *brute(tuple((r, x) for _, r, x in rows)))
    return found


def odd_rows(seed, number, convs):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "unit", "User"], ["", None, "a.", "b", "c!", " ", "x?\n", "é。", "w" * 20_000 + "."]
    return [(rng.choice(convs), rng.choice([None, *range(14)]), rng.choice(roles), rng.choice(texts), 1, "c", 2) for _ in range(number)]


def told(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("block", [2, 4096])
def test_query_is_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    table = odd_rows(block, 260, [None, *range(30)])
    spark.createDataFrame(table, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    df = op12_conversation_repair(spark, str(tmp_path))
    assert df.count() == len({r[0] for r in table}) and told(df) == expected(table)


def test_one_conversation_in_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 7)
    rng = random.Random(4)
    table = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["yes.", "no", f"text {k}.", f"cut {k}"]), 1, "c", 2) for k in range(400)]
    spark.createDataFrame(table, ROWS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert told(op12_conversation_repair(spark, str(tmp_path))) == expected(table)


def test_repaired_rows_follow_the_grammar(spark):
    table = [r for r in odd_rows(9, 150, [*range(12)]) if r[0] is not None]
    made = repair.Repairs(repair.rows_of(spark.createDataFrame(table, ROWS)))
    lines = defaultdict(list)
    for r in made.rows().collect():
        lines[r.conv].append((r.pos, r["sub"], r.edit, r.role, r.text))
    digests = {r.conv: r for r in made.summary().collect()}
    for conv, r in digests.items():
        rows = sorted(lines[conv])
        assert re.fullmatch("(s?(ua)+)?", "".join(x[3][:1] for x in rows))
        assert "".join(x[2] for x in rows) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{x[3]}:{x[4]}" for x in rows).encode()).hexdigest() == r.repaired_sha256


def test_nothing_is_left_or_there(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "c", 2)], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert told(op12_conversation_repair(spark, str(tmp_path))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op12_conversation_repair(spark, f"{tmp_path}/none").collect() == []


def test_machines_that_labels_cannot_tell_apart():
    with pytest.raises(ValueError):
        repair.Machine(arcs=({"u": 0, "a": 0},), accepting=frozenset({0}))
    with pytest.raises(ValueError):
        repair.Machine(insert=0)
    other = repair.Machine(arcs=({"u": 1}, {"a": 0}), written={"u": "user", "a": "assistant"}, delete=1)
    ways = other.back([("a", repair.SOUND), ("u", repair.SOUND)], [w[0] for w in other.end()])
    codes, state = other.walk(ways, 0)
    assert (ways[0][0][0], codes, other.tail(state)) == (2, ["D", "D"], "")
