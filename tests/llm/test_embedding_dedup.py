"""Similar vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from sheetwise.catalog.registry import table
from sheetwise.llm import embedding_dedup
from sheetwise.llm.embedding_dedup import similar_vectors


def all_pairs(rows, threshold=0.93):
    """Links and component of each row, by cosine in double precision."""
    usable = {}
    for at, (_, vector, label) in enumerate(rows):
        if label is None or vector is None or not len(vector) or any(x is None for x in vector):
            continue
        v = np.array(vector, float)
        if np.isfinite(v).all() and v.any():
            usable.setdefault((label, len(v)), []).append((at, v / np.linalg.norm(v)))
    links, root = [0] * len(rows), list(range(len(rows)))
    for group in usable.values():
        at = [a for a, _ in group]
        units = np.stack([v for _, v in group])
        near = units @ units.T >= threshold
        np.fill_diagonal(near, False)
        for i, j in zip(*np.nonzero(near), strict=True):
            links[at[i]] += 1
            a, b = at[i], at[j]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    ids = []
    for a in range(len(rows)):
        while root[a] != a:
            a = root[a]
        ids.append(rows[a][0])
    return links, ids


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, digest string")
    found = {r["vec_id"]: r for r in similar_vectors(frame).collect()}
    return [(found[r[0]]["n_links"], found[r[0]]["component_id"], found[r[0]]["kept"]) for r in rows]


def clusters(seed, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for size in (1, 2, 5, 40, 1, 1, 3) * 4:
        base = rng.standard_normal(dim)
        spread = rng.choice([0.05, 0.15, 0.25])
        for _ in range(size):
            rows.append((base + spread * rng.standard_normal(dim)).astype(np.float32).tolist())
    return [(i, v, int(rng.integers(0, 2))) for i, v in enumerate(rows)]


def test_recall_and_precision(spark):
    rows = clusters(3)
    found, (links, ids) = run(spark, rows), all_pairs(rows)
    assert all(f[0] <= w for f, w in zip(found, links, strict=True))  # no link below the threshold
    assert sum(f[0] for f in found) >= 0.95 * sum(links)
    assert np.mean([f[1] == w for f, w in zip(found, ids, strict=True)]) > 0.97
    assert all(f[2] == (f[1] == r[0]) for f, r in zip(found, rows, strict=True))


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rows = [(i, v, 1) for i, (_, v, _) in enumerate(clusters(5))]
    found, (links, _) = run(spark, rows), all_pairs(rows)
    assert all(f[0] <= w for f, w in zip(found, links, strict=True))
    assert sum(f[0] for f in found) >= 0.95 * sum(links)


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (0, None, 1), (1, [], 1), (2, [0.0] * 4, 1), (3, [1.0, None, 0.0, 0.0], 1), (4, [float("nan"), 1.0, 0.0, 0.0], 1),
        (5, [float("inf"), 1.0, 0.0, 0.0], 1), (6, one, None), (7, one, 1), (8, one, 1), (9, [x * 1e30 for x in one], 1),
        (10, one, 2), (11, one[:3], 1), (12, [-x for x in one], 1), (13, one, None), (14, [1.0, 2.0, 3.0, 4.0, 0.0], 1),
        (15, [-0.0, 0.0, 1.0, 0.0], 1), (16, [0.0, 0.0, 1.0, 0.0], 1),
    ]
    links, ids = all_pairs(rows)
    assert [f[:2] for f in run(spark, rows)] == list(zip(links, ids, strict=True))
    assert run(spark, []) == []


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_vectors(spark, sf):
    given = table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in given.collect()]
    found = {r["vec_id"]: r for r in similar_vectors(given).collect()}
    links, ids = all_pairs(rows)
    got = [(found[r[0]]["n_links"], found[r[0]]["component_id"]) for r in rows]
    assert sum(g[0] for g in got) >= 0.95 * sum(links)
    assert np.mean([g[1] == w for g, w in zip(got, ids, strict=True)]) > 0.99


def test_vectors_with_a_large_common_mean(spark):
    rng = np.random.default_rng(9)

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    common = unit(rng.standard_normal(64))
    vectors = unit(0.92 * common + 0.39 * unit(rng.standard_normal((3000, 64))))
    noise = rng.standard_normal(vectors.shape)
    noise -= (noise * vectors).sum(1, keepdims=True) * vectors
    near = 0.935 * vectors + (1 - 0.935**2) ** 0.5 * unit(noise)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([vectors, near]))]
    found, (links, ids) = run(spark, rows), all_pairs(rows)
    assert all(f[0] <= w for f, w in zip(found, links, strict=True))
    assert sum(f[0] for f in found) >= 0.97 * sum(links)
    assert np.mean([f[1] == w for f, w in zip(found, ids, strict=True)]) > 0.95
