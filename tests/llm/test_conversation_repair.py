"""Repairs against a search over all edits."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import sys
import zlib

import pytest

from sheetwise.llm import conversation_repair as repair
from sheetwise.llm.queries import QUERIES
from tests.conftest import SF

SPACES = " \t\n\x0b\x0c\r"
sys.setrecursionlimit(20_000)


def cheapest(symbols):
    """Least cost and ASCII-least audit, by a search over rows, states and edits."""
    due, after = "uuau", (2, 2, 3, 2)

    @functools.cache
    def best(i, state, inserts):
        found = []
        if i == len(symbols) and state in (0, 3):
            found.append((0, ""))
        if inserts < 3:
            cost, audit = best(i, after[state], inserts + 1)
            found.append((cost + 2, "I" + audit))
        if i < len(symbols):
            role, fault = symbols[i]
            options = [("D", 3, state)]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role == due[state] or (role == "s" and state == 0):
                    options.append(("K", more, 1 if role == "s" else after[state]))
                options.append(("R", 2 + more, after[state]))
            for letter, cost, target in options:
                rest, audit = best(i + 1, target, 0)
                found.append((rest + cost, letter + audit))
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def brute(rows):
    """The query's rows by conversation."""
    found = {}
    for conv_id in dict.fromkeys(r[0] for r in rows):
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv_id):
            role, text = " " if role is None else role, " " if text is None else text
            key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
            kind = zlib.crc32(key.encode()) % 20
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            last = text.rstrip(SPACES)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
        cost, audit = cheapest(tuple(zip(initials, faults, strict=True)))
        lines, state, rest = [], 0, list(own)
        for letter in audit:
            row = None if letter == "I" else rest.pop(0)
            if letter == "D":
                continue
            role = row[1] if letter == "K" else ("user", "user", "assistant", "user")[state]
            state = 1 if letter == "K" and role[:1] == "s" else (2, 2, 3, 2)[state]
            lines.append(f"{role}:{row[2] if row else ''}")
        assert not rest and state in (0, 3)
        found[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report(rows):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(repair.damage(rows)).collect()}


def test_audit_is_the_cheapest_and_least():
    rng, costs = random.Random(5), repair.Costs()
    faults = ["", "blank", "duplicate", "truncated"]
    for n in range(2500):
        kinds = rng.sample([(r, f) for r in "suax" for f in faults], rng.randint(1, 4))
        own = []
        while len(own) < rng.randint(0, 14):
            own += [rng.choice(kinds)] * rng.choice([1, 1, 2, 5])
        symbols = bytes("suax".index(r) * 4 + faults.index(f) for r, f in own)
        assert costs.audit(symbols) == cheapest(tuple(own)), (n, own)


def test_long_runs_equal_single_steps(monkeypatch):
    costs = repair.Costs()
    for symbol in range(16):
        for rows in (1, 2, 7, 64, 100, 1000):
            one = costs.end
            for _ in range(rows):
                one = costs.advance(symbol, 1, one)
            assert costs.advance(symbol, rows, costs.end) == one
    symbols = bytes([4] * 3000 + [8] * 5000 + [4, 8] * 700 + [5] * 1000 + [15] * 1234)
    whole = costs.audit(symbols)
    monkeypatch.setattr(repair, "BLOCK", 100)
    assert repair.Costs().audit(symbols) == whole
    assert len(whole[1].replace("I", "")) == len(symbols) and len(costs.vectors) < 100


def made(rng, n):
    texts = ["Yes.", "Yes.", "no", " ", "", "Really?\n", "cut off ", "Wow!", " ", "e.g. this.", "two\nlines.", None]
    rows = []
    for conv in [None, *range(n)]:
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "tool", None, "", "system", "usher"]])
        turns = list(range(rng.randint(0, 9)))
        for t in turns:
            role = roles[t % len(roles)] if rng.random() < 0.7 else rng.choice(roles)
            turn = rng.choice([t, t, t, t, t + 3, None])
            rows += [(conv, turn, role, rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.randint(0, 9999)}.")] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("partitions", ["8", "1"])
def test_equals_a_search(spark, partitions):
    rows = made(random.Random(6), 400)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, number int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert report(frame) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_one_long_conversation(spark):
    rng = random.Random(7)
    rows = [(1, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "tool", f"Text {t}." + "x" * (t % 9)) for t in range(600)]
    rows += [(2, t, "user", "Same.") for t in range(300)] + [(3, 0, "user", "long " * 200_000 + ".")]
    assert report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == brute(rows)


def test_repaired_rows(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "user", "Hi."), ("a", 3, "tool", "Done."), ("b", 1, "assistant", "Well.")]
    frame = spark.createDataFrame([(*r, False) for r in rows], "conv_id string, turn int, role string, text string, dropped boolean")
    judged = repair.audits(repair.symbols(frame))
    found = repair.repaired(frame, judged).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in found] == [
        ("a", 0, "K", 1, "user", "Hi."), ("a", 1, "R", 3, "assistant", "Done."),
        ("b", 0, "I", None, "user", ""), ("b", 1, "K", 1, "assistant", "Well."),
    ]


def test_empty_table(spark):
    assert report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == {}


def test_query_equals_a_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert found == brute(rows)


def test_texts_are_shuffled_once(spark, plan_of):
    frame = repair.damage(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert "text" not in repair.symbols(frame).columns
    judged = spark.createDataFrame([], "conv_id long, audit string")
    plan = plan_of(repair.transcript_digests(repair.repaired(frame, judged)))
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.MULTILINE)) == 1
