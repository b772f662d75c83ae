"""Byte-level BPE with cuts that the vocabulary forces, and decoding.

A token can only hold byte pairs that occur inside some token of the vocabulary. Wherever a text has
another pair, every encoding has a token boundary, because no merge can ever produce a token across
it. Texts are cut at these pairs, the fragments are merged independently of each other and their ids
are put together again.

The library also cuts texts by a pattern (letters, digits, signs, blanks) before it merges. Where a forced
pair is also a certain end of a match of that pattern, whatever stands around it (a letter before
another ASCII character, or anything before ASCII white space), the parts on both sides are independent of
each other as a whole, and parts met before are looked up. New parts are cut by the library's own
pattern, then at all other forced pairs, and the fragments of many texts are merged together: in each
step every fragment merges the pair that the vocabulary learned first, until none is left. Very long
fragments are merged with a queue instead, in time n log n.

Added tokens (such as the end of a text) are ids of their own wherever their content occurs; the text
before and behind is encoded by itself, as the library does.

Defined results:

* null and empty texts have no ids, which decode to the empty text.
* very long texts are encoded and decoded whole, in parts of bounded size; a row must fit into a task.
* repeated rows are encoded once each, alike; null ids are kept. An empty table gives an empty result.
* decoding leaves out ids that the vocabulary does not have; bytes that are no UTF-8 become U+FFFD.
* the operators are columns over a text or ids; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts whose ids a task keeps, and the longest part that is kept.
PARTS_KEPT = 400_000
LONGEST_KEPT = 64
#: Texts whose new parts are merged together, and bytes of a text that are cut at once.
BYTES_AT_ONCE = 1 << 20
#: Fragments above this length are merged one by one.
LONG_FRAGMENT = 128
IDS_AT_ONCE = 1 << 18
NO_RANK = np.iinfo(np.int32).max
WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
#: Parts that the library's pattern does not cut: a blank at most, then letters, digits or signs alone.
WHOLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)")

_models: dict[str, ByteBPE] = {}


def byte_letters() -> dict[str, int]:
    """Byte that each character of the vocabulary's spelling stands for: printable Latin-1 characters are
    themselves, the others follow from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.pattern = Tokenizer.from_file(path).pre_tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = byte_letters(), spec["model"]
        added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("Added tokens that take characters around them are not supported")
        ids = model["vocab"]
        spelled = {i: bytes(map(letters.__getitem__, token)) for token, i in ids.items()}
        self.byte_ids = np.zeros(256, np.int32)
        for token in spelled.values():
            if len(token) == 1:
                self.byte_ids[token[0]] = ids[next(c for c, b in letters.items() if b == token[0])]
        inside = np.zeros((256, 256), bool)
        for token in spelled.values():
            inside[list(token[:-1]), list(token[1:])] = True
        self.forced = ~inside.ravel()
        ascii_other = ~LETTER & (np.arange(256) < 0x80)
        sure = (LETTER[:, None] & ascii_other) | (~WHITE[:, None] & WHITE)
        self.sure = self.forced & sure.ravel()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max([*spelled, *added.values()]) + 1
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.rank_of = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(merges)}
        one = self.byte_ids.astype(np.int64)
        self.byte_ranks = self._pair_ranks(np.repeat(one, 256), np.tile(one, 256))
        self.added = added
        self.added_pattern = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")") if added else None
        spelled |= {i: content for content, i in added.items()}
        self.lengths = np.array([len(spelled.get(i, b"")) for i in range(self.size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spelling = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(self.size)), np.uint8)
        self.parts: dict[bytes, bytes] = {}

    def cuts(self, data: bytes, table: np.ndarray) -> np.ndarray:
        """Where a pair of the table stands, as places of its second byte."""
        codes = np.frombuffer(data, np.uint8).astype(np.uint16)
        return np.flatnonzero(table[(codes[:-1] << 8) | codes[1:]]) + 1

    def _cut(self, data: bytes) -> list[bytes]:
        bounds = [0, *self.cuts(data, self.sure).tolist(), len(data)] if data else [0]
        return [data[a:b] for a, b in itertools.pairwise(bounds)]

    def _sections(self, data: bytes):
        """The text between added tokens, in parts of about ``BYTES_AT_ONCE``, and the added tokens."""
        if self.added_pattern is None or not self.added_pattern.search(data):
            pieces = [data]
        else:
            pieces = self.added_pattern.split(data)
        for number, piece in enumerate(pieces):
            if number % 2:
                yield None, np.array([self.added[piece]], "<u4").tobytes()
            elif len(piece) <= BYTES_AT_ONCE:
                yield self._cut(piece), b""
            else:
                places, first = self.cuts(piece, self.sure), 0
                while first < len(piece):
                    behind = places[np.searchsorted(places, first + BYTES_AT_ONCE) :]
                    last = int(behind[0]) if len(behind) else len(piece)
                    yield self._cut(piece[first:last]), b""
                    first = last

    def _begins(self, parts: list[bytes], data: bytes) -> np.ndarray:
        """Which bytes of the joined parts begin a fragment."""
        codes = np.frombuffer(data, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        starts = np.r_[0, ends[:-1]]
        begins = np.zeros(len(data), bool)
        begins[starts] = True
        # a blank at most and then letters: the pattern takes such a part whole
        plain = LETTER[codes] | (begins & (codes == 0x20))
        for k in np.flatnonzero(~np.logical_and.reduceat(plain, starts)).tolist():
            if not WHOLE.fullmatch(parts[k]):
                text, first = parts[k].decode(), int(starts[k])
                for _, (a, b) in self.pattern.pre_tokenize_str(text):
                    begins[first] = True
                    first += len(text[a:b].encode())
        begins[self.cuts(data, self.forced)] = True
        return begins

    def merge(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts, none of them empty."""
        if not parts:
            return []
        data = b"".join(parts)
        begins = self._begins(parts, data)
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.r_[starts, len(data)])
        codes = np.frombuffer(data, np.uint8)
        ids, at, ends = self.byte_ids[codes], np.arange(len(data), dtype=np.int32), np.r_[begins[1:], True]
        done_at, done_ids = [], []
        for k in np.flatnonzero(sizes > LONG_FRAGMENT).tolist():
            places, found = self._merge_long(ids[starts[k] : starts[k] + sizes[k]].tolist())
            done_at.append(np.array(places) + starts[k])
            done_ids.append(np.array(found, np.int32))
        rank = np.full(len(ids), NO_RANK, np.int32)
        rank[:-1] = self.byte_ranks[(codes[:-1].astype(np.uint16) << 8) | codes[1:]]
        rank[ends] = NO_RANK
        active = np.repeat(sizes <= LONG_FRAGMENT, sizes)
        ids, at, ends, rank = ids[active], at[active], ends[active], rank[active]
        while len(ids):
            first = np.r_[0, np.flatnonzero(ends)[:-1] + 1]
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(ids)]))
            open_ = least != NO_RANK
            done_at.append(at[~open_])
            done_ids.append(ids[~open_])
            chosen = (rank == least) & open_
            doubled = chosen[1:] & chosen[:-1]
            if doubled.any():  # of overlapping pairs (aaa) every second one, from the left
                place = np.arange(len(ids))
                begin = np.maximum.accumulate(np.where(chosen & ~np.r_[False, doubled], place, 0))
                chosen &= (place - begin) % 2 == 0
            into = np.flatnonzero(chosen)
            ids[into], ends[into] = self.merged[rank[into]], ends[into + 1]
            open_[into + 1] = False
            ids, at, ends, rank, chosen = ids[open_], at[open_], ends[open_], rank[open_], chosen[open_]
            chosen[:-1] |= chosen[1:]
            changed = np.flatnonzero(chosen & ~ends)
            rank[chosen] = NO_RANK
            rank[changed] = self._pair_ranks(ids[changed], ids[changed + 1])
        at, ids = np.concatenate(done_at), np.concatenate(done_ids)
        order = np.argsort(at, kind="stable")
        joined = ids[order].astype("<u4").tobytes()
        behind = np.searchsorted(at[order], np.cumsum([len(p) for p in parts])) * 4
        return [joined[a:b] for a, b in itertools.pairwise([0, *behind.tolist()])]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``NO_RANK`` where the vocabulary has no such pair."""
        pairs = left.astype(np.int64) * self.size + right
        place = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[place] == pairs, self.ranks[place], NO_RANK)

    def _merge_long(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Places and ids of the tokens of one fragment: a queue of pairs over a linked list."""
        end = len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        rank_of = self.rank_of
        queue = [(r, i) for i, pair in enumerate(itertools.pairwise(ids)) if (r := rank_of.get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j == end or rank_of.get((ids[i], ids[j])) != rank:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := rank_of.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, (r, i))
            h = before[i]
            if h >= 0 and (r := rank_of.get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, (r, h))
        places = [i for i in range(end) if ids[i] >= 0]
        return places, [ids[i] for i in places]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers; new parts are merged together."""
        found: list[list[bytes]] = [[] for _ in texts]
        held, waiting = 0, []
        for number, data in enumerate(texts):
            for parts, known in self._sections(data):
                waiting.append((found[number], parts, known))
                held += sum(map(len, parts or ()))
                if held > BYTES_AT_ONCE:
                    self._look_up(waiting)
                    held, waiting = 0, []
        self._look_up(waiting)
        return [b"".join(x) for x in found]

    def _look_up(self, waiting: list[tuple[list[bytes], list[bytes] | None, bytes]]) -> None:
        """Append the ids of waiting parts (or of an added token) to their texts."""
        if len(self.parts) > PARTS_KEPT:
            self.parts = {}
        new = list(set(itertools.chain.from_iterable(parts or () for _, parts, _ in waiting)).difference(self.parts))
        self.parts.update(zip(new, self.merge(new), strict=True))
        known = self.parts.__getitem__
        for out, parts, ids in waiting:
            out.append(ids if parts is None else b"".join(map(known, parts)))
        for part in new:
            if len(part) > LONGEST_KEPT:
                del self.parts[part]

    def decode(self, ids: bytes) -> bytes:
        numbers, out = np.frombuffer(ids, "<u4"), []
        for first in range(0, len(numbers), IDS_AT_ONCE):
            some = numbers[first : first + IDS_AT_ONCE].astype(np.int64)
            some = some[some < self.size]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.starts[some] - (ends - lengths), lengths)
            out.append(self.spelling[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)


def _model(path: str) -> ByteBPE:
    if path not in _models:
        _models[path] = ByteBPE(path)
    return _models[path]


def ids_of(text: Column, tokenizer: str) -> Column:
    """Ids of a text as binary, 4 bytes per id."""

    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(_model(tokenizer).encode([t or b"" for t in texts.to_pylist()]), pa.binary())

    return F.arrow_udf(encode, T.BinaryType())(text.cast("binary"))


def text_of(ids: Column, tokenizer: str) -> Column:
    """The text of ids as ``ids_of`` gives them."""

    def decode(rows: pa.Array) -> pa.Array:
        model = _model(tokenizer)
        return pa.array([model.decode(x or b"").decode(errors="replace") for x in rows.to_pylist()], pa.string())

    return F.arrow_udf(decode, T.StringType())(ids)
