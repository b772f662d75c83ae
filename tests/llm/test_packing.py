"""Packing against brute force, token ids against the tokenizer itself."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheetwise.llm import packing
from sheetwise.llm.queries import word_tokenizer

TEXTS = [
    None, "", "Hello, WORLD. don't", "a.b,c., x's 'LL é ́x ﬁ \x00 \x0b ΑΣ. ΑΣ İstanbul", "<|endoftext|> x",
    "word " * 5000, "A" * 3000 + ".,", "\u00a0x\u2003y", "same", "same",
]


def fewest(items, size):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - items[i]])
        place(i + 1, [*rooms, size - items[i]])

    place(0, [])
    return best[0]


def test_fewest_sequences():
    rng = random.Random(9)
    for _ in range(150):
        size = rng.choice([10, 20, 50])
        items = [rng.randint(1, size) if rng.random() < 0.5 else rng.randint(size // 5, size // 2) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(items, minlength=size + 1)
        found = packing.bin_completion(counts, size)
        assert sorted(x for b in found for x in b) == sorted(items) and all(sum(b) <= size for b in found)
        best = fewest(items, size)
        assert len(found) == best and packing.lower_bound(counts, size) <= best


def test_many_pieces_come_close_to_the_bound():
    rng = np.random.default_rng(4)
    counts = np.bincount(rng.integers(1, 2049, 4000), minlength=2049)
    assert len(packing.bin_completion(counts, 2048)) <= packing.lower_bound(counts, 2048) * 1.01 + 1


def test_pieces_and_places(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, block int")
    pieces = packing.token_pieces(docs, word_tokenizer())
    rows = packing.pack(pieces.withColumn("crc", F.crc32("ids"))).collect()
    tokenizer = Tokenizer.from_file(word_tokenizer())
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist()
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [2048 * k for k in range(len(own))]
        assert all(r["length"] == 2048 for r in own[:-1])
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for taken in places.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) == -(-sum(r["length"] for r in rows) // 2048)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.token_pieces(docs, word_tokenizer())).count() == 0
