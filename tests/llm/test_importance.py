"""Importance resampling: held-out accuracy, the k-th value, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sheetwise.catalog.registry import table
from sheetwise.llm.importance import Resampler, calibrate, importance_sample, importance_stage, kth_largest

SF = "/root/testdata/sf0.1"


def test_keeps_clean_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held_out = labels.filter("doc_id % 3 = 0")
    kept = importance_sample(docs, labels.filter("doc_id % 3 <> 0")).select("doc_id", "sampled.kept")
    rates = {
        (r["quality"], r["toxic"]): r["rate"]
        for r in kept.join(held_out, "doc_id").groupBy("quality", "toxic").agg({"kept": "count"}).join(
            kept.filter("kept").join(held_out, "doc_id").groupBy("quality", "toxic").count(), ["quality", "toxic"]
        ).selectExpr("quality", "toxic", "count / `count(kept)` AS rate").collect()
    }
    assert rates[1, 0] > 0.96 and rates.get((0, 0), 0) < 0.12 and rates.get((1, 1), 0) < 0.3


def test_kth_largest(spark):
    rng = random.Random(1)
    for values in ([5.0], [1.0] * 50, [rng.gauss(0, 1) for _ in range(3000)], [rng.choice([1.0, 2.0, 1e300, -1e-300]) for _ in range(400)],
                   [0.0, 5e-324], [float(i // 7) for i in range(5000)]):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        ordered = sorted(values, reverse=True)
        for k in {1, len(values) // 3 + 1, len(values)}:
            assert kth_largest(frame, "v", k, bins=16) == ordered[k - 1]


def test_calibration_recovers_odds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2)) * [1, 5] + [3, 0]
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [1.0, 0.3] - 2)))).astype(float)
    assert np.allclose(calibrate(x, y), [1.0, 0.3, -2.0], atol=0.3)


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "house", "stands", "on", "hills", "green"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["###", "BUY!!", "$$$", "win"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)] + [(1000, None), (1001, ""), (None, good()), (1, "x"), (1002, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, labelled_id string, target int")
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 600, 2)] + [(2, 0, 0), (None, 1, 0), (4, None, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_odd_rows(small):
    docs, labels = small
    rows = importance_sample(docs, labels).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r["sampled"].kept for r in rows}
    right = [by_id[i] == (i % 3 > 0) for i in range(2, 600)]
    assert np.mean(right) > 0.97
    assert importance_stage(docs, labels).columns == docs.columns
    again = {(r["doc_id"], r["text"]): r["sampled"] for r in importance_sample(docs.repartition(3), labels).collect()}
    assert all(again[r["doc_id"], r["text"]].kept == r["sampled"].kept for r in rows)


def test_without_targets_or_rows(small):
    docs, labels = small
    assert importance_stage(docs, labels.limit(0)).count() == docs.count()
    assert importance_stage(docs, labels.filter("quality = 0")).count() == docs.count()
    assert importance_stage(docs.limit(0), labels).count() == 0
    assert Resampler(docs.limit(0), labels).cut() == float("-inf")
