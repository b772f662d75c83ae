"""Divergence of sources against a direct count over all terms and pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheetwise.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def direct(docs, min_docs):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
        groups[lang].add(source)
    rows = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(count, kept=kept):
            size = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (size + 2 * len(kept)) for t in kept}

        own, all_ = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pair = [(-sum((own[s][t] - own[o][t]) ** 2 // (own[s][t] + own[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [
                (-((own[s][t] - all_[t]) ** 2 // (own[s][t] + all_[t])), t.encode())
                for t in kept if counts[lang, s][t] and own[s][t] > all_[t]
            ]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:10])):
                rows += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(rows)


def made(rng, n, sources, words):
    docs = []
    for _ in range(n):
        source = rng.choice(sources) if rng.random() < 0.6 else sources[0]
        lean = words[hash(source or "") % 7 :]
        text = " ".join(rng.choice(lean if rng.random() < 0.7 else words) for _ in range(rng.randint(0, 30)))
        docs.append((rng.choice([text, text, text.upper(), None]), rng.choice(["en", "en", "en", "fr", None]), source))
    return docs


SCHEMA = "text string, lang string, source string"


def found(spark, docs, min_docs, **options):
    frame = spark.createDataFrame([(*d, i, "x", 3) for i, d in enumerate(docs)], f"{SCHEMA}, doc_id long, term string, n int")
    rows = divergence.source_divergence(frame, min_docs, **options).collect()
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in rows)


@pytest.mark.parametrize("nodes", [1 << 18, 3])
def test_equals_a_direct_count(spark, monkeypatch, nodes):
    monkeypatch.setattr(divergence, "NODES", nodes)
    rng = random.Random(nodes)
    words = ["the", "An", "été", "naïve", "x1y", "don't", "ÀB", "日本", "zz", "q", "word", "Word", "other", "æ_ø", "k"]
    docs = made(rng, 400, ["src0", "a", "B", "é", "", None, "src1", "z", "only"], words)
    docs += [("zz zz zz zz", "en", "hot")] * 50 + [(None, "de", "s"), ("", "de", "t"), ("rare", "de", "u"), ("one", "xx", "single")]
    assert found(spark, docs, 5) == direct(docs, 5)


def test_small_sums_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 4)
    monkeypatch.setattr(divergence, "BYTES_AT_ONCE", 50)
    rng = random.Random(2)
    docs = made(rng, 60, ["a", "b", "c"], [f"w{chr(97 + i)}" for i in range(12)]) + [("long text é " * 3000, "en", "a"), ("x" * 5000, "en", "b")]
    assert found(spark, docs, 2) == direct(docs, 2)


def test_no_kept_terms_and_empty_table(spark):
    docs = [("some words", "en", "a"), ("other text", "en", "b")]
    assert found(spark, docs, 10) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_paths_meet_their_ancestors_once():
    rng = np.random.default_rng(3)
    paths = Counter()
    for _ in range(300):
        paths[tuple((f"s{i}", int(rng.integers(1, 3)) * 1000, 7 + i) for i in range(6) if rng.random() < 0.6) or (("s0", 1000, 7),)] += 1
    tree, wanted = divergence._Tree(), Counter()
    for path, n in sorted(paths.items()):
        tree.insert(list(path), n)
        for j, (b, q, zq) in enumerate(path):
            for a, p, zp in path[:j]:
                f = lambda x, y: (x - y) ** 2 // (x + y)
                wanted[a, b] += n * (f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq))
    names, a, b, value = tree.corrections()
    assert {(names[i], names[j]): v for i, j, v in zip(a, b, value.tolist(), strict=True)} == dict(wanted)
    assert len(tree.items) < sum(len(p) for p in paths) < sum(len(p) * n for p, n in paths.items())


def test_shares_do_not_overflow(spark):
    row = spark.range(1).select(divergence.share(divergence.F.lit(4 * 10**14 + 1), divergence.F.lit(9 * 10**14 + 7)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (4 * 10**14 + 1) // (9 * 10**14 + 7)
