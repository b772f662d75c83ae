"""Packing of tokenised documents into as few sequences as possible.

Documents become token ids, an end id behind each. Only documents longer than a sequence are cut.
Pieces are dealt into blocks by a hash of their row, so a block holds about ``BLOCK`` of them,
whatever their documents; each block is packed by itself, at a loss of less than one sequence.

Within a block: best-fit decreasing gives the first solution and a lower bound on the number of
sequences tells whether it can be improved. If so, bin completion takes over: the largest piece
left has to lie in some sequence, so the search branches over the fillings around it, the fullest
first, leaves out fillings that another one dominates, and gives up a branch when the room wasted
so far rules out a better solution than the one at hand. Of the fillings around a piece it tries the
fullest and the undominated of the first ``WIDTH``, largest pieces first. The search ends at the
lower bound, which is a proof, when no filling of these is left, or after ``NODES`` branches; in the
last two cases the best solution found stands and may have a sequence too many.

Tokens of a document are the tokens of its words (runs between ASCII blanks): the vocabulary drops
white space, so no token spans a blank. Words met before are looked up, not tokenised again.

Defined results:

* null and empty texts have only the end id: one piece of length 1.
* very long texts are tokenised whole, in one task, and cut into pieces.
* ties: pieces of equal length are interchangeable, so which of them takes a place may differ between runs; the
  number of sequences does not.
* repeated rows are packed once each; null ids are kept. An empty table gives an empty result.
* other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.common import stored, with_row_key

SEQUENCE = 2048
BLOCK = 16384
NODES = 20_000
#: Fillings around one piece that the search tries besides the fullest.
WIDTH = 64
WORDS_KEPT = 250_000
#: Texts whose new words are tokenised together.
TEXTS_AT_ONCE = 64
END_ID = 0

#: Lower-case letters of ASCII and Latin-1, as UTF-8; lower-casing and composing leave them alone.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, word by word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids per word. Words of plain letters are encoded as one text: each ends with its only token
        that closes a word."""
        plain = [w for w in words if LETTERS.fullmatch(w)]
        joined = self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)
        ids = np.array(joined[0].ids, "<u4")
        bounds = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        data = ids.tobytes()
        found = dict(zip(plain, [data[a:b] for a, b in itertools.pairwise(bounds)], strict=True))
        rest = [w for w in words if w not in found]
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        found.update(zip(rest, [np.array(e.ids, "<u4").tobytes() for e in encoded], strict=True))
        return [found[w] for w in words]

    def _learn(self, words: set[bytes]) -> None:
        """Letters and the points or commas behind them are tokens apart."""
        table, parts, new = self.words, [], set()
        for word in words:
            core = word.rstrip(b".,")
            if len(core) < len(word) and core[-1:].isalpha():
                tail = word[len(core) :]
                parts.append((word, core, tail))
                new.add(core)
                new.add(tail)
            else:
                new.add(word)
        missing = list(new.difference(table))
        table.update(zip(missing, self._ids(missing), strict=True))
        for word, core, tail in parts:
            table[word] = table[core] + table[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of a few texts, whose new words are tokenised together."""
        split = [text.encode().lower().split() for text in texts]
        if len(self.words) > WORDS_KEPT:
            self.words = {}
        new = set().union(*split).difference(self.words)
        if new:
            self._learn(new)
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(path: str, size: int):
    kind = T.StructType(
        [
            T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        ]
    )

    def cut(texts: pa.Array) -> pa.Array:
        encoder, end = _encoder(path), np.array([END_ID], "<u4").tobytes()
        counts, rows = [0], []
        for first in range(0, len(texts), TEXTS_AT_ONCE):
            for ids in encoder.encode([t or "" for t in texts.slice(first, TEXTS_AT_ONCE).to_pylist()]):
                ids += end
                for at in range(0, len(ids), 4 * size):
                    part = ids[at : at + 4 * size]
                    rows.append((at // (4 * size), at // 4, len(part) // 4, part))
                counts.append(len(rows))
        columns = zip(*rows, strict=True) if rows else ([],) * 4
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        values = pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=kind.names
        )
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), values)

    return F.arrow_udf(cut, T.ArrayType(kind))


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids``: at most ``size`` ids each, as 4 bytes per id."""
    cut = docs.select("doc_id", F.explode(_pieces(tokenizer, size)("text")).alias("p"))
    return cut.select("doc_id", "p.*")


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Sequences needed at least: pieces over ``size - k`` stand alone, those over half apart."""
    lengths = np.arange(size + 1)
    total = np.cumsum(counts * lengths)
    number = np.cumsum(counts)
    half = size // 2
    best = -(-int(total[size]) // size)
    for k in range(half + 1):
        alone = number[size] - number[size - k]
        apart = number[size - k] - number[half]
        room = apart * size - (total[size - k] - total[half])
        rest = total[half] - (total[k - 1] if k else 0)
        best = max(best, int(alone + apart + max(0, -(-(rest - room) // size))))
    return best


def best_fit(counts: np.ndarray, size: int) -> list[list[int]]:
    """Largest piece first, each into the fullest sequence that still has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set if some sequence has room r
    for length in range(size, 0, -1):
        for _ in range(counts[length]):
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                at = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
                bins[at].append(length)
            else:
                room, at = size, len(bins)
                bins.append([length])
            left = room - length
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


def _fullest(counts: np.ndarray, room: int) -> tuple[int, ...]:
    """Pieces with the largest sum up to ``room``: one or two if they fill it, else by subset sums."""
    lengths = np.flatnonzero(counts[: room + 1])
    if not len(lengths):
        return ()
    if lengths[-1] == room:
        return (room,)
    floor = np.zeros(room + 1, np.int64)
    floor[lengths] = lengths
    floor = np.maximum.accumulate(floor)
    partner = floor[room - lengths]
    exact = (partner + lengths == room) & (partner <= lengths) & ((partner < lengths) | (counts[lengths] > 1))
    if exact.any():
        at = np.flatnonzero(exact)[-1]
        return (int(lengths[at]), int(partner[at]))
    within = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths[::-1].tolist():
        for _ in range(min(int(counts[length]), room // length)):
            grown = (reach | reach << length) & within
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
        if reach >> room:
            break
    left, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            chosen.append(length)
            left -= length
    return tuple(sorted(chosen, reverse=True))


def _maximal(lengths: list[int], counts: np.ndarray, room: int, first: int = 0):
    """Fillings to which no piece can be added, larger pieces first."""
    fits = False
    for i in range(first, len(lengths)):
        length = lengths[i]
        if length <= room and counts[length]:
            fits = True
            counts[length] -= 1
            try:
                for rest in _maximal(lengths, counts, room - length, i):
                    yield (length, *rest)
            finally:
                counts[length] += 1
    if not fits and not any(counts[x] and x <= room for x in lengths[:first]):
        yield ()


def _dominated(one: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the pieces of ``one`` fit into places that those of ``other`` take."""
    if one == other:
        return False
    rooms = sorted(other, reverse=True)
    for length in one:
        at = next((i for i, r in enumerate(rooms) if r >= length), None)
        if at is None:
            return False
        rooms[at] -= length
    return True


def _fillings(counts: np.ndarray, room: int, best: tuple[int, ...]) -> list[tuple[int, ...]]:
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    found = {best, *itertools.islice(_maximal(lengths, counts.copy(), room), WIDTH)}
    kept = [a for a in found if not any(_dominated(a, b) for b in found)]
    return sorted(kept, key=lambda f: (-sum(f), len(f), f))


def bin_completion(counts: np.ndarray, size: int, nodes: int = NODES) -> list[list[int]]:
    """Sequences of lengths that use every piece counted in ``counts`` (index: length)."""
    counts = counts.copy()
    best, least = best_fit(counts, size), lower_bound(counts, size)
    total = int((counts * np.arange(size + 1)).sum())
    left = int(counts.sum())
    path: list[tuple[int, tuple[int, ...]]] = []
    options: list[list[tuple[int, ...]] | None] = []
    waste, tried = 0, 0

    def largest() -> int:
        return int(np.flatnonzero(counts)[-1])

    def take(x: int, filling: tuple[int, ...], sign: int) -> int:
        for length in (x, *filling):
            counts[length] += sign
        return size - x - sum(filling)

    while len(best) > least and tried < nodes + len(best):
        tried += 1
        spare = (len(best) - 1) * size - total  # what a better solution may waste
        if left and waste <= spare:
            x = largest()
            counts[x] -= 1
            filling = _fullest(counts, size - x)
            counts[x] += 1
            path.append((x, filling))
            options.append(None)
            waste += take(x, filling, -1)
            left -= 1 + len(filling)
            continue
        if not left and waste <= spare:
            best = [[x, *filling] for x, filling in path]
            continue
        while path:  # back to a piece with another filling
            x, filling = path.pop()
            others = options.pop()
            waste -= take(x, filling, 1)
            left += 1 + len(filling)
            if others is None:
                counts[x] -= 1
                others = [f for f in _fillings(counts, size - x, filling) if f != filling]
                counts[x] += 1
            if others:
                other = others.pop(0)
                path.append((x, other))
                options.append(others)
                waste += take(x, other, -1)
                left -= 1 + len(other)
                break
        else:
            break  # every filling within WIDTH is tried: no proof beyond it
    return best


def _pack_block(size: int):
    def pack(block: pa.Table) -> pa.Table:
        lengths = block.column("length").to_numpy()
        waiting = {}
        for at in np.argsort(lengths, kind="stable").tolist():
            waiting.setdefault(int(lengths[at]), []).append(at)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        first = block.column("block")[0].as_py() << 32
        for number, pieces in enumerate(bin_completion(np.bincount(lengths, minlength=size + 1), size)):
            place = 0
            for length in pieces:
                at = waiting[length].pop()
                sequence[at], offset[at] = first + number, place
                place += length
        packed = block.append_column("sequence_id", pa.array(sequence))
        return packed.append_column("offset", pa.array(offset)).drop_columns(["block"])

    return pack


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """All columns of ``pieces`` and the place of each piece, ``sequence_id`` and ``offset``."""
    whole = stored(pieces, "pieces")
    blocks = max(1, -(-whole.count() // BLOCK))
    place = F.pmod(F.xxhash64("piece_row.file", "piece_row.row"), F.lit(blocks))
    dealt = with_row_key(whole, "piece_row").withColumn("block", place).drop("piece_row")
    fields = [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return dealt.groupBy("block").applyInArrow(_pack_block(size), T.StructType(fields))
