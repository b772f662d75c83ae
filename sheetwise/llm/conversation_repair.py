"""Cheapest repair of the turn structure of conversations.

A conversation is well formed if it is empty, or user and assistant take turns (the user first), with one system turn
in front at most. Rows may be kept, given another role, deleted or inserted; ``audits`` finds the
cheapest edits and of equally cheap ones the ASCII-least string of their initials (D, I, K, R).

Every row is a symbol: the kind of its role and its first fault. The edits that take a row from one
state of the turn pattern to another cost what a 4 x 4 matrix of its symbol says, in min-plus arithmetic. A run of
equal symbols is one step with a power of that matrix, put together from its squares, which are kept.
The runs are advanced from the last to the first, and the costs at their ends (less the least one, so that only
few different vectors occur) are held. Then the choices are unrolled from the front: at each row the
first letter that keeps the cost; inside a long run the costs come from its powers, block by block.

Where the data is large: faults, and which rows repeat an earlier one, come from joins and windows of narrow
rows without texts. A task then streams sorted conversations and holds one byte per row of the one at
hand, two per run, and its audit, which is one value of the result. The texts are shuffled once, when ``repaired`` lays
the audit beside the sorted rows, and stream through; a digest over a transcript is sequential by
definition, so a conversation with a third of all rows passes through one task, in bounded memory.

Defined results:

* null conversations are one conversation of their own and null turns come first in it. Null roles and texts
  are one space (``damage``), so such rows are blank or have a role that no place allows.
* rows of the same turn are taken in the order of role, then of the text's SHA-256. Repeated rows are duplicates.
* texts are equal if their SHA-256 is. Very long texts are judged, kept and hashed whole.
* a conversation without rows has no faults, cost 0 and an empty audit; an empty table gives an empty result.
* other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import partitions, stored

SPACES = " \t\n\x0b\x0c\r"
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after the system turn, after a user's turn, after an assistant's turn.
STATES = 4
#: Role that is due in each state, and the state behind it.
DUE = (USER, USER, ASSISTANT, USER)
NEXT = (2, 2, 3, 2)
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 40
#: Rows of a run whose costs are held while its choices are unrolled.
BLOCK = 4096
#: Kept results for short runs and short conversations.
KEPT = 100_000
SHORT = 64

Vector = tuple[int, ...]


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of the edits that use up a row, by letter."""
    role, fault = divmod(symbol, 4)
    found = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        stays = STAYS_TRUNCATED if fault == TRUNCATED else 0
        if role == DUE[state]:
            found.append(("K", stays, NEXT[state]))
        elif role == SYSTEM and state == 0:
            found.append(("K", stays, 1))
        found.append(("R", REROLE + stays, NEXT[state]))
    return found


class Costs:
    """Costs to the end of a conversation, by state, and the choices that reach them."""

    def __init__(self):
        self.powers: dict[int, list[list[list[int]]]] = {}
        self.runs: dict[tuple[int, int, Vector, int], tuple[str, int]] = {}
        self.whole: dict[bytes, tuple[int, str]] = {}
        self.end = self._inserted([0, NEVER, NEVER, 0])
        self.interned: dict[Vector, int] = {}
        self.vectors: list[Vector] = []

    @staticmethod
    def _inserted(costs: list[int]) -> Vector:
        """Costs by state, if turns may be inserted first."""
        for _ in range(STATES):
            costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
        return tuple(costs)

    def power(self, symbol: int, bit: int) -> list[list[int]]:
        """The matrix of ``2 ** bit`` rows of a symbol."""
        own = self.powers.setdefault(symbol, [])
        while len(own) <= bit:
            if own:
                a = own[-1]
                own.append([[min(a[s][m] + a[m][t] for m in range(STATES)) for t in range(STATES)] for s in range(STATES)])
                continue
            columns = []
            for target in range(STATES):
                used = [min([c for _, c, t in edits(symbol, s) if t == target], default=NEVER) for s in range(STATES)]
                columns.append(self._inserted(used))
            own.append([[min(columns[t][s], NEVER) for t in range(STATES)] for s in range(STATES)])
        return own[bit]

    def advance(self, symbol: int, rows: int, costs: Vector) -> Vector:
        """Costs before a run, from those behind it."""
        bit = 0
        while rows:
            if rows & 1:
                matrix = self.power(symbol, bit)
                costs = tuple(min(m + c for m, c in zip(line, costs, strict=True)) for line in matrix)
            rows >>= 1
            bit += 1
        return costs

    def unroll(self, symbol: int, rows: int, costs: Vector, state: int) -> tuple[str, int]:
        """Letters for a run with ``costs`` behind it, and the state behind it."""
        key = (symbol, rows, costs, state)
        if key in self.runs:
            return self.runs[key]
        letters: list[str] = []
        left = rows
        while left:
            block = min(left, BLOCK)
            behind = [self.advance(symbol, left - block, costs)]
            for _ in range(block):
                behind.append(self.advance(symbol, 1, behind[-1]))
            for here, after in itertools.pairwise(reversed(behind)):
                state = self._row(symbol, here, after, state, letters)
            left -= block
        found = "".join(letters), state
        if rows <= SHORT:
            if len(self.runs) >= KEPT:
                self.runs.clear()
            self.runs[key] = found
        return found

    def _row(self, symbol: int, here: Vector, after: Vector, state: int, letters: list[str]) -> int:
        while True:
            steps = {letter: (cost + after[target], target) for letter, cost, target in edits(symbol, state)}
            due = INSERT + here[NEXT[state]], NEXT[state]
            for letter, (cost, target) in sorted([*steps.items(), ("I", due)]):
                if cost == here[state]:
                    letters.append(letter)
                    state = target
                    break
            if letters[-1] != "I":
                return state

    def audit(self, symbols: bytes) -> tuple[int, str]:
        """Least cost of a conversation, and the letters of its edits."""
        if symbols in self.whole:
            return self.whole[symbols]
        codes = np.frombuffer(symbols, np.uint8)
        firsts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
        lengths = np.diff(np.r_[firsts, len(codes)])
        costs, total, held = self.end, 0, array("H")
        for first, rows in zip(firsts[::-1], lengths[::-1], strict=True):
            held.append(self._code(costs))
            costs = self.advance(symbols[first], int(rows), costs)
            least = min(costs)
            total, costs = total + least, tuple(c - least for c in costs)
        state, letters = 0, []
        total += costs[0]
        for first, rows in zip(firsts, lengths, strict=True):
            some, state = self.unroll(symbols[first], int(rows), self.vectors[held.pop()], state)
            letters.append(some)
        while self.end[state]:
            letters.append("I")
            state = NEXT[state]
        found = total, "".join(letters)
        if len(symbols) <= SHORT:
            if len(self.whole) >= KEPT:
                self.whole.clear()
            self.whole[symbols] = found
        return found

    def _code(self, costs: Vector) -> int:
        if costs not in self.interned:
            self.interned[costs] = len(self.vectors)
            self.vectors.append(costs)
        return self.interned[costs]


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: rows dropped (marked), emptied, cut, repeated or given to the user, by a checksum."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"),
        (kind == 0).alias("dropped"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)


def symbols(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, number, symbol``: the kind of role and the first fault of each row; null for dropped rows.

    ``number`` counts rows of equal role and text in a conversation. Texts stay behind.
    """
    trimmed = F.rtrim("text", F.lit(SPACES))
    judged = rows.select(
        "conv_id", "turn", "role", "dropped", _digest(F.col("text")).alias("digest"),
        F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED).alias("own"),
    )
    order = Window.partitionBy("conv_id", "role", "digest", "dropped").orderBy(F.asc_nulls_first("turn"))
    numbered = judged.withColumn("number", F.row_number().over(order))
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("number") > 1, DUPLICATE).otherwise(F.col("own"))
    symbol = F.when(~F.col("dropped"), _initial(F.col("role")) * 4 + fault).cast("int")
    return numbered.select("conv_id", "turn", "role", "digest", "number", symbol.alias("symbol"))


LEGAL = np.zeros((4, 4), bool)
LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True


def _same_runs(column: pa.Array) -> list[int]:
    """Bounds of runs of equal values, nulls equal to each other."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]


class _Conversation:
    """What is held of the conversation at hand."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols = conv_id, bytearray()
        self.first = self.last = None
        self.distinct = 0

    def add(self, turns: pa.Array, symbols: pa.Array) -> None:
        kept = symbols.is_valid()
        self.symbols += symbols.filter(kept).cast(pa.uint8()).to_numpy().tobytes()
        turns = turns.filter(kept).drop_null().to_numpy()
        if len(turns):
            self.distinct += 1 + int((turns[1:] != turns[:-1]).sum()) - int(turns[0] == self.last)
            self.first = int(turns[0]) if self.first is None else self.first
            self.last = int(turns[-1])

    def report(self, costs: Costs) -> tuple:
        codes = np.frombuffer(bytes(self.symbols), np.uint8)
        roles, faults = codes // 4, np.bincount(codes % 4, minlength=4).tolist()
        illegal = int((~LEGAL[roles[:-1], roles[1:]]).sum())
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return (self.conv_id, gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, *costs.audit(bytes(self.symbols)))


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    costs, held, done, kind = Costs(), None, [], None
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def out() -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        ids = batch.column("conv_id")
        for a, b in itertools.pairwise(_same_runs(ids)):
            conv_id = ids[a].as_py()
            if held is None or held.conv_id != conv_id:
                if held is not None:
                    done.append(held.report(costs))
                held = _Conversation(conv_id)
            held.add(batch.column("turn").slice(a, b - a), batch.column("symbol").slice(a, b - a))
        if len(done) > 1000:
            yield out()
    if held is not None:
        done.append(held.report(costs))
        yield out()


def audits(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of ``symbols(rows)``, one row per conversation."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "number"]
    dealt = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return dealt.select("conv_id", "turn", "symbol").mapInArrow(_audit, f"conv_id {kind}, {counts}, audit string")


class _Edits:
    """The letters of one conversation, applied to its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.place = audit, 0, 0, 0

    def inserts(self) -> Iterator[tuple[int, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._put(NAMES[DUE[self.state]])
            self.state = NEXT[self.state]
            self.at += 1

    def _put(self, role: str) -> tuple[int, str]:
        self.place += 1
        return self.place - 1, role

    def row(self, role: str) -> tuple[str, tuple[int, str] | None]:
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return letter, None
        put = self._put(role if letter == "K" else NAMES[DUE[self.state]])
        self.state = 1 if letter == "K" and role[:1] == "s" else NEXT[self.state]
        return letter, put


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: _Edits | None = None
    held_id = None
    for batch in batches:
        ids, texts = batch.column("conv_id"), batch.column("text")
        out_ids, out_turns, place, roles, letters, take = [], [], [], [], [], []

        def put(conv_id, turn, letter, made, at):
            out_ids.append(conv_id)
            out_turns.append(turn)
            place.append(made[0])
            roles.append(made[1])
            letters.append(letter)
            take.append(at)

        columns = [batch.column(c).to_pylist() for c in ("audit", "turn", "role")]
        for at, (conv_id, audit, turn, role) in enumerate(zip(ids.to_pylist(), *columns, strict=True)):
            if audit is not None:  # the audit stands before the rows of its conversation
                if held is not None:
                    for made in held.inserts():
                        put(held_id, None, "I", made, None)
                held, held_id = _Edits(audit), conv_id
                continue
            for made in held.inserts():
                put(conv_id, None, "I", made, None)
            letter, made = held.row(role)
            if made is not None:
                put(conv_id, turn, letter, made, at)
        if out_ids:
            text = texts.take(pa.array(take, pa.int64())).fill_null("")
            arrays = [pa.array(out_ids, ids.type), pa.array(place, pa.int64()), pa.array(letters), pa.array(out_turns, batch.column("turn").type), pa.array(roles), text]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "place", "edit", "turn", "role", "text"])
    if held is not None:
        left = [(held_id, *made) for made in held.inserts()]
        if left:
            conv, place, roles = (list(x) for x in zip(*left, strict=True))
            n = len(left)
            arrays = [pa.array(conv, ids.type), pa.array(place, pa.int64()), pa.array(["I"] * n), pa.nulls(n, batch.column("turn").type), pa.array(roles), pa.array([""] * n)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "place", "edit", "turn", "role", "text"])


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """``conv_id, place, edit, turn, role, text``: the rows of repaired conversations, each conversation's together and in order."""
    turn, kind = rows.schema["turn"].dataType.simpleString(), rows.schema["conv_id"].dataType.simpleString()
    heads = judged.select("conv_id", "audit", F.lit(None).cast(turn).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = rows.filter(~F.col("dropped")).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    both = heads.unionByName(texts).repartition(partitions(rows.sparkSession), "conv_id")
    order = ["conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", _digest(F.col("text"))]
    dealt = both.sortWithinPartitions(*order)
    return dealt.mapInArrow(_repair, f"conv_id {kind}, place long, edit string, turn {turn}, role string, text string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, running = None, None
    for batch in batches:
        ids, done = batch.column("conv_id"), []
        columns = [batch.column(c).to_pylist() for c in ("place", "role", "text")]
        for conv_id, place, role, text in zip(ids.to_pylist(), *columns, strict=True):
            if place == 0:
                if running is not None:
                    done.append((held, running.hexdigest()))
                held, running = conv_id, hashlib.sha256()
            running.update(f"{'' if place == 0 else chr(10)}{role}:".encode())
            running.update(text.encode())
        yield _digests(done, ids.type)
    if running is not None:
        yield _digests([(held, running.hexdigest())], ids.type)


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "sha256"])


def transcript_digests(rows: DataFrame) -> DataFrame:
    """``conv_id, sha256`` over ``role:text`` of the rows of ``repaired``, newline between; they must not be moved in between."""
    return rows.mapInArrow(_hashed, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of the repaired transcript, one row per conversation."""
    judged = stored(audits(symbols(rows)), "audits")
    digests = transcript_digests(repaired(rows, judged)).withColumnRenamed("conv_id", "repaired_id")
    joined = judged.join(digests, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return joined.select(*judged.columns, F.coalesce("sha256", empty).alias("repaired_sha256"))
