"""Runs of sorted rows across batches, and chains."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

from sheetwise.llm.groups import chains, runs


@pytest.mark.parametrize("sizes", [[3], [1], [2, 5, 1], [0, 4], [100]])
def test_runs_across_batches(sizes):
    rows = [(1, "a")] * 4 + [(1, "b")] + [(2, "b")] * 7 + [(3, None)] * 2
    batches, at = [], 0
    for size in itertools.cycle(sizes):
        if at >= len(rows):
            break
        part, at = rows[at : at + size], at + size
        columns = [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string())]
        batches.append(pa.RecordBatch.from_arrays(columns, names=["x", "y"]))
    found = [list(zip(*run.to_pydict().values(), strict=True)) for run in runs(batches, ["x", "y"])]
    assert found == [[(1, "a")] * 4, [(1, "b")], [(2, "b")] * 7, [(3, None)] * 2]
    assert list(runs([], ["x"])) == []


def test_chains():
    linked = np.zeros((7, 7), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert chains(linked) == [(0, 3), (3, 5), (1, 2)]
