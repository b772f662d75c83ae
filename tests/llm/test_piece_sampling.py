"""Sampled segmentations: round trip, reproducible, and with the right probabilities."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest

from sheetwise.llm.piece_sampling import PieceSampler, sample_pieces
from sheetwise.llm.queries import piece_model

TEXTS = [
    "", " ", "  two  blanks ", "\n\n x\n", "▁literal ▁", "é\x00\U0001f600 ñ 漢字 \u0301", "a" * 20_000, " " * 500,
    "Plain words, with points. And\ttabs", "x" + "\u00a0" * 5,
]


@pytest.fixture(scope="module")
def sampler():
    return PieceSampler(piece_model(), 0.5)


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def test_round_trip(sampler):
    for seed in range(3):
        found = sampler.encode(TEXTS, [seed] * len(TEXTS))
        assert [sampler.vocabulary.decode(ids_of(x)) for x in found] == TEXTS


def test_same_whatever_is_sampled_with_it(sampler):
    together = sampler.encode(TEXTS, list(range(len(TEXTS))))
    alone = [PieceSampler(piece_model(), 0.5).encode([t], [i])[0] for i, t in enumerate(TEXTS)]
    assert together == alone


def test_probabilities(sampler):
    v, draws = sampler.vocabulary, 40_000

    def paths(word):
        if not word:
            yield (), 0.0
        for k in range(1, len(word) + 1):
            if word[:k] in v.weights:
                for rest, weight in paths(word[k:]):
                    yield (v.ids[word[:k]], *rest), 0.5 * v.weights[word[:k]] + weight

    for text in ("thinking", "ééa"):
        chances = {p: math.exp(w) for p, w in paths(b" " + text.encode())}
        whole = sum(chances.values())
        found = collections.Counter(tuple(ids_of(x)) for x in sampler.encode([text] * draws, list(range(draws))))
        assert set(found) <= set(chances)
        for path, chance in chances.items():
            p = chance / whole
            assert abs(found[path] / draws - p) < 5 * math.sqrt(p * (1 - p) / draws) + 2 / draws


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(50, None, "x"), (None, "no key", "x"), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sample_pieces(docs, piece_model()).collect()
    assert len(found) == len(rows) and all(r["decoded"] == r["text"] for r in found)
    again = {(r["doc_id"], r["text"]): r["ids"] for r in sample_pieces(docs.repartition(5), piece_model()).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["ids"] for r in found)
    assert [r["ids"] for r in found if r["doc_id"] == 50] == [None]
    assert sample_pieces(docs.limit(0), piece_model()).count() == 0
