"""Near-duplicate documents against all pairs of sets."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from sheetwise.llm import common, near_dedup
from sheetwise.llm.components import components
from sheetwise.llm.near_dedup import near_dedup_stage, near_duplicates


def sets_of(texts, words):
    found = []
    for text in texts:
        tokens = (text or "").encode().lower().split()
        found.append(frozenset(tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))) if tokens else frozenset())
    return found


def groups_of(texts, words, percent):
    sets = sets_of(texts, words)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def corpus(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(25))
    texts: list[str | None] = [None, "", " \n", "one", "One", "one two", "one\ttwo", "ÉÉ x y z", "éé x y z"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(10, 150))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([passage] + [word() for _ in range(rng.randint(20, 60))]) for _ in range(40)]
    long = [word() for _ in range(20_000)]
    return [*texts, " ".join(long), " ".join(long[:-500]), texts[9], texts[9]]


def check(spark, texts, words, percent):
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, node int")
    found = {r["doc_id"]: r for r in near_duplicates(docs, words, percent).collect()}
    wanted = groups_of(texts, words, percent)
    assert [(found[i]["n_shingles"], found[i]["component_id"]) for i in range(len(texts))] == wanted
    assert all(r["kept"] == (i == wanted[i][1]) == r["first"] for i, r in found.items())
    kept = near_dedup_stage(docs) if (words, percent) == (5, 80) else None
    if kept is not None:
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, w in enumerate(wanted) if w[1] == i)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, words, percent):
    check(spark, corpus(words), words, percent)


def test_large_cluster_in_blocks(spark, monkeypatch):
    """A chain and a crowd of near copies, compared in small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "LEAF_BLOCK", 16)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        copy = list(words)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(100)] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    chain = [f"c{i}" for i in range(160)]
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 60, 4)]
    check(spark, texts, 3, 85)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(3, text), (3, text), (None, text), (None, "alone alone alone"), (1, None), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == sorted(
        [(3, 3, True), (3, 3, True), (0, 3, False), (0, 0, True), (1, 1, True), (1, 1, True)]
    )
    assert sorted((r["doc_id"] or 0) for r in near_dedup_stage(docs).collect()) == [0, 1, 1, 3]
    assert near_dedup_stage(docs.limit(0)).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    wanted = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (near_dedup.shared_counts(sets) == wanted).all()


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + i) for i in range(1, 60)] + [(400 + i, 399) for i in range(30)]
    links += [(b, a) for a, b in (rng.sample(range(500, 700), 2) for _ in range(150))] + [(7, 7), (800, 800)]
    parent = {n: n for link in links for n in link}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: root(n) for n in parent if n != 800}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_numbers_rows_once(spark, monkeypatch):
    written, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: (written.append(name), stored(df, name))[1])
    docs = spark.createDataFrame([(i, f"the same words in text {i % 3} of a few", "s") for i in range(9)], "doc_id long, text string, source string")
    kept = near_dedup_stage(docs.distinct())
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2] and written.count("rows") == 1
