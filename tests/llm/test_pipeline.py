"""The pipeline over the given documents, stage by stage."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.llm.queries import QUERIES
from sheetwise.llm.secret_scan import base_spans
from tests.conftest import SF
from tests.llm.test_near_dedup import groups_of
from tests.llm.test_quality_rules import slow


@pytest.fixture(scope="module")
def results(spark):
    rows, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.stored(stage(spark, rows, SF), "stage")
        found.append(rows)
    return found


def test_stages(spark, results):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    sampled, judged, single, masked, packed = results
    assert all(r.columns == documents.columns for r in results[:-1])
    labels = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in sampled.collect()}
    clean = [i in kept for i, good in labels.items() if good]
    assert np.mean(clean) > 0.9 and sampled.count() < documents.count()
    passed = {r["doc_id"] for r in judged.collect()}
    for r in sampled.collect():
        n_words, *_, repeated = slow(r["text"])
        assert (r["doc_id"] in passed) == (n_words >= 10 and 100 * repeated <= 20 * n_words)
    rows = sorted(judged.collect(), key=lambda r: r["doc_id"])
    groups = groups_of([r["text"] for r in rows], 5, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == [rows[i]["doc_id"] for i, g in enumerate(groups) if g[1] == i]
    assert masked.count() == single.count() and masked.filter(base_spans(masked["text"]) != base_spans(masked["text"].substr(1, 0))).isEmpty()
    pieces = packed.collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in masked.collect()}
    assert len({r["sequence_id"] for r in pieces}) == -(-sum(r["length"] for r in pieces) // 2048)


def test_run_is_the_stages(spark, results):
    places = ["doc_id", "piece", "length", "ids_crc32"]
    run = sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*places).collect()))
    assert run == sorted(map(tuple, results[-1].select(*places).collect()))


def test_registered_operators():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("empty", [True, False])
def test_odd_tables_run_through(spark, tmp_path, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [
        (None, None, None, None, None), (1, "", "", "", 0), (2, None, "en", None, None), (2, "same text " * 30, "en", "src0", 1),
        (2, "same text " * 30, "en", "src0", 1), (3, "word " * 120_000, None, "src1", 2),
    ]
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([] if empty else rows, COLUMNS)
    docs = odd if empty else odd.unionByName(given)
    clash = {c: F.lit(1) for c in ("ids", "block", "kept", "measured", "sampled", "piece", "row")}
    docs.withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert (packed.count() == 0) == empty
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns)
