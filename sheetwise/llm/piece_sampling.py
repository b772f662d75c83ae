"""Sampled segmentation into the pieces of a SentencePiece model, and lossless decoding.

A text is a path through the lattice of all vocabulary pieces that match somewhere in it. Paths are
drawn with probability proportional to the product of their pieces' weights: forward filtering sums
the weights of all paths to each position, backward sampling walks from the end and chooses each
piece by its share. The vocabulary orders pieces by merge rank, so a piece's weight is that of its
rank under Zipf's law, to the power ``alpha``.

Where two neighbouring bytes stand next to each other in no piece, every path has a break, so the
lattice falls apart into short parts there ("words" below). Filtered lattices of words are kept in each
task, and all words of many texts are sampled together. Random numbers are hashes of the row's seed, the place
of the word and the step, so a row has the same segmentation in every run, whatever its partition.

Lossless: nothing is normalised. One blank is put in front of the text and taken away by decoding. A
character without a piece is written as its bytes; so is the character that stands for a blank in
the vocabulary's own spelling.

Defined results:

* null text: null ids, which decode to null. Empty text: the ids of one blank, decoding to empty.
* very long texts are sampled and decoded whole, each in one task.
* repeated rows (same key and text) have the same ids. An empty table gives an empty result.
* other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHA = 0.5
SEED = 23
WORDS_KEPT = 350_000
#: Words that are sampled at once.
BATCH_WORDS = 200_000
#: First bits of a hash by which most positions are known to begin no piece of a length.
SEEN_BITS = 18
IDS_AT_ONCE = 1 << 18
BLANK = "▁"
#: Log weight of a byte of a character that has no piece.
BYTE_WEIGHT = -10.0
ALL = (1 << 64) - 1
LAST_SHARE = (1 << 32) - 1
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_samplers: dict[tuple[str, float], PieceSampler] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
POWERS = np.cumprod(np.r_[np.uint64(1), np.full(255, BASE)])


class Vocabulary:
    """Pieces as bytes, with their ids and log weights."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids: dict[bytes, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.spelled: list[bytes] = [b""] * size
        normal = []
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.byte_ids[value], self.spelled[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append((-model.get_score(i), i, model.id_to_piece(i).replace(BLANK, " ").encode()))
        zipf = math.log(sum(1 / (rank + 1) for rank in range(len(normal))))
        self.weights: dict[bytes, float] = {}
        for rank, (_, i, piece) in enumerate(sorted(normal)):
            self.spelled[i] = piece
            self.ids[piece] = i
            self.weights[piece] = -math.log(rank + 1) - zipf
        by_length: dict[int, list[bytes]] = {}
        for piece in self.weights:
            by_length.setdefault(len(piece), []).append(piece)
        self.by_length = {n: self._hashed(pieces) for n, pieces in sorted(by_length.items())}
        together = np.zeros((256, 256), bool)
        for piece in self.weights:
            together[list(piece[:-1]), list(piece[1:])] = True
        together[:, 0x80:0xC0] = True  # bytes of one character
        self.apart = ~together.ravel()
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spelling = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.byte_table = np.array([self.byte_ids[b] for b in range(256)])

    def _hashed(self, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        """Sorted hashes of pieces of one length, their ids and log weights, and which hash beginnings there are."""
        codes = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)
        hashes = (BYTE_HASH[codes] * POWERS[: codes.shape[1]]).sum(1)
        order = np.argsort(hashes)
        ids, weights = np.array([self.ids[x] for x in pieces]), np.array([self.weights[x] for x in pieces])
        seen = np.zeros(1 << SEEN_BITS, bool)
        seen[hashes >> np.uint64(64 - SEEN_BITS)] = True
        return hashes[order], ids[order], weights[order], seen

    def words(self, text: str) -> list[bytes]:
        """The text with a blank before it, cut where no piece reaches over."""
        data = b" " + text.encode()
        codes = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(self.apart[codes[:-1].astype(np.intp) * 256 + codes[1:]]) + 1
        return [data[a:b] for a, b in itertools.pairwise([0, *cuts.tolist(), len(data)])]

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes of all pieces, gathered by their places, without the blank in front."""
        ids, out = np.asarray(ids, np.int64), []
        for first in range(0, len(ids), IDS_AT_ONCE):
            some = ids[first : first + IDS_AT_ONCE]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.starts[some] - (ends - lengths), lengths)
            out.append(self.spelling[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)[1:].decode()


class Grown:
    """An array that is added to; it doubles when it is full, so what is there is seldom moved."""

    def __init__(self, kind: type):
        self.held, self.size = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.held):
            self.held = np.concatenate([self.held[: self.size], np.zeros(max(size, 2 * len(self.held)) - self.size, self.held.dtype)])
        self.held[self.size : size] = values
        self.size = size


class PieceSampler:
    """Filtered lattices of words in flat arrays.

    A node is a position in a word behind its start; its edges are the pieces that end there, each
    with the node where it starts (-1: the word's start). They stand together from ``first_edge`` on, and ``share`` is the
    sum of probabilities up to the edge, the last one's the largest number, so a draw takes the first edge
    whose share it does not exceed.
    """

    def __init__(self, path: str, alpha: float):
        self.vocabulary, self.alpha = Vocabulary(path), alpha
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.share, self.start, self.piece = Grown(np.uint32), Grown(np.int32), Grown(np.int32)
        self.first_edge = Grown(np.int32)
        self.nodes = 0

    def _edges(self, data: np.ndarray, left: np.ndarray, first: np.ndarray):
        """All pieces in the words side by side in ``data``: (start, end, id, log weight).

        ``left``: bytes from a position to the end of its word.
        """
        v = self.vocabulary
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(data), BASE)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(data), BASE_INVERSE)])
        sums = np.r_[np.uint64(0), np.cumsum(BYTE_HASH[data] * power[:-1])]
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.select([data[heads] < 0x80, data[heads] < 0xE0, data[heads] < 0xF0], [1, 2, 3], 4)
        whole = np.zeros(len(heads), bool)  # characters that are pieces
        found = []
        at = heads
        for length, (hashes, ids, weights, seen) in v.by_length.items():
            at = at[left[at] >= length]
            wanted = (sums[at + length] - sums[at]) * back[at]
            likely = np.flatnonzero(seen[wanted >> np.uint64(64 - SEEN_BITS)])  # few others need no search
            wanted = wanted[likely]
            near = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
            hit = hashes[near] == wanted
            starts, near = at[likely[hit]], near[hit]
            found.append((starts, starts + length, ids[near], self.alpha * weights[near]))
            if length <= 4:
                begun = np.zeros(len(data), bool)
                begun[starts] = True
                whole |= (width == length) & begun[heads]
        lost = np.repeat(heads[~whole], width[~whole])
        if len(lost):  # written byte by byte
            widths = width[~whole]
            inner = np.arange(len(lost)) - np.repeat(np.cumsum(widths) - widths, widths)
            at = lost + inner
            found.append((at, at + 1, v.byte_table[data[at]], np.full(len(at), BYTE_WEIGHT * self.alpha)))
        return [np.concatenate(c) for c in zip(*found, strict=True)]

    def _learn(self, words: list[bytes]) -> None:
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)  # of the position's word
        left = first + np.repeat(sizes, sizes) - np.arange(len(data))
        start, end, piece, weight = self._edges(data, left, first)
        node = end - 1  # nodes are numbered like bytes
        order = np.argsort(node, kind="stable")
        start, node, piece, weight = (c[order] for c in (start, node, piece, weight))
        depth, begins = node - first[node], start == first[node]
        by_depth = np.argsort(depth.astype(np.uint16) if depth.max() < 1 << 16 else depth, kind="stable")
        levels = depth[by_depth]
        bounds = np.flatnonzero(np.r_[True, levels[1:] != levels[:-1], True])
        filtered = np.zeros(len(data))  # log of the summed weights of all paths to a node
        chance = np.zeros(len(node))
        for low, high in itertools.pairwise(bounds.tolist()):
            at = by_depth[low:high]
            value, to = weight[at], node[at]
            if levels[low]:
                value = value + np.where(begins[at], 0.0, filtered[start[at] - 1])
            heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            counts = np.diff(np.r_[heads, high - low])
            top = np.maximum.reduceat(value, heads)
            part = np.exp(value - np.repeat(top, counts))
            whole = np.add.reduceat(part, heads)
            filtered[to[heads]] = top + np.log(whole)
            chance[at] = part / np.repeat(whole, counts)
        heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        counts = np.diff(np.r_[heads, len(node)])
        place = np.arange(len(node)) - np.repeat(heads, counts)
        for k in range(1, int(counts.max())):  # edge by edge, so sums do not depend on other words
            at = np.flatnonzero(place == k)
            chance[at] += chance[at - 1]
        upto = np.minimum((chance * 2.0**32).astype(np.uint64), np.uint64(LAST_SHARE))
        upto[heads + counts - 1] = LAST_SHARE
        begin = np.zeros(len(data), np.int32)
        begin[node[heads]] = self.share.size + heads
        self.first_edge.add(begin)
        self.share.add(upto)
        self.start.add(np.where(begins, -1, self.nodes + start - 1))
        self.piece.add(piece)
        self.words.update(zip(words, (self.nodes + np.cumsum(sizes) - 1).tolist(), strict=True))
        self.nodes += len(data)

    def encode(self, texts: list[str], seeds: list[int]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found, waiting, words = [], [], 0
        for text, seed in zip(texts, seeds, strict=True):
            parts = self.vocabulary.words(text)
            waiting.append((parts, seed))
            words += len(parts)
            if words >= BATCH_WORDS:
                found += self._sample(waiting)
                waiting, words = [], 0
        return found + self._sample(waiting)

    def _sample(self, texts: list[tuple[list[bytes], int]]) -> list[bytes]:
        if not texts:
            return []
        if len(self.words) > WORDS_KEPT:
            self._clear()
        if new := set().union(*[parts for parts, _ in texts]).difference(self.words):
            self._learn(list(new))
        words = itertools.chain.from_iterable(parts for parts, _ in texts)
        counts = np.array([len(parts) for parts, _ in texts])
        last = np.fromiter(map(self.words.__getitem__, words), np.int32, int(counts.sum()))
        seeds = np.array([seed for _, seed in texts], np.int64).view(np.uint64)
        first = np.cumsum(counts) - counts
        place = (np.arange(len(last)) - np.repeat(first, counts)).astype(np.uint64)
        keys = mix(np.repeat(mix(seeds + np.uint64(1)), counts) + place * np.uint64(0x9E3779B97F4A7C15))
        share, start, piece, first_edge = (x.held for x in (self.share, self.start, self.piece, self.first_edge))
        node, word = last, np.arange(len(last))
        lengths = np.zeros(len(last), np.int64)
        steps = []
        step = 0
        while len(node):
            step += 1
            draw = mix(keys[word] + np.uint64(step * 0xD6E8FEB86659FD93 & ALL)) >> np.uint64(32)
            edge = first_edge[node]
            drawn = np.minimum(draw, np.uint64(LAST_SHARE)).astype(np.uint32)
            beyond = np.flatnonzero(share[edge] < drawn)
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[share[edge[beyond]] < drawn[beyond]]
            steps.append((word, piece[edge]))
            lengths[word] += 1
            node = start[edge]
            going = node >= 0
            node, word = node[going], word[going]
        ends = np.cumsum(lengths)
        ids = np.zeros(ends[-1] if len(ends) else 0, "<u4")
        for back, (word, pieces) in enumerate(steps):
            ids[ends[word] - 1 - back] = pieces
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _sampler(path: str, alpha: float) -> PieceSampler:
    if (path, alpha) not in _samplers:
        _samplers[path, alpha] = PieceSampler(path, alpha)
    return _samplers[path, alpha]


def _encoder(path: str, alpha: float):
    def encode(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        present = [i for i, t in enumerate(texts) if t.is_valid]
        values = seeds.to_pylist()
        found = _sampler(path, alpha).encode([texts[i].as_py() for i in present], [values[i] for i in present])
        rows: list[bytes | None] = [None] * len(texts)
        for i, ids in zip(present, found, strict=True):
            rows[i] = ids
        return pa.array(rows, pa.binary())

    return F.arrow_udf(encode, T.BinaryType())


def _decoder(path: str):
    def decode(rows: pa.Array) -> pa.Array:
        vocabulary = _sampler(path, ALPHA).vocabulary
        texts = [vocabulary.decode(np.frombuffer(r.as_py(), "<u4")) if r.is_valid else None for r in rows]
        return pa.array(texts, pa.string())

    return F.arrow_udf(decode, T.StringType())


def sampled_ids(path: str, text: Column, key: Column, alpha: float = ALPHA) -> Column:
    """Sampled ids of a text, 4 bytes each, drawn by the row's key."""
    return _encoder(path, alpha)(text, F.xxhash64(key, F.lit(SEED)))


def decoded(path: str, ids: Column) -> Column:
    return _decoder(path)(ids)


def sample_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """``doc_id, text, ids, decoded`` per document."""
    encoded = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        sampled_ids(path, F.col(text), F.col(doc_id), alpha).alias("ids"),
    )
    return encoded.withColumn("decoded", decoded(path, F.col("ids")))
