"""Helpers inside tasks: runs of sorted rows, and chains through linked members."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa


def runs(batches, keys: list[str]):
    """Runs of rows with equal keys, from batches sorted by them."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        ends = _ends(held, keys)
        for start, end in itertools.pairwise([0, *ends]):
            yield held.slice(start, end - start)
        held = held.slice(ends[-1] if ends else 0)
    if held is not None and held.num_rows:
        yield held


def _ends(table: pa.Table, keys: list[str]) -> list[int]:
    """Where runs of equal keys end, but for the last run."""
    if table.num_rows < 2:
        return []
    changed = np.zeros(table.num_rows - 1, bool)
    for key in keys:
        codes = table.column(key).combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        changed |= np.diff(codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)) != 0
    return (np.flatnonzero(changed) + 1).tolist()


def chains(linked: np.ndarray) -> list[tuple[int, int]]:
    """Chains through the connected groups of a symmetric matrix of links."""
    open_, links = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not open_[start]:
            continue
        group = np.zeros(len(linked), bool)
        group[start], front = True, np.array([start])
        while len(front):
            reached = linked[front].any(0) & ~group
            group |= reached
            front = np.flatnonzero(reached)
        open_ &= ~group
        members = np.flatnonzero(group).tolist()
        links += zip(members[:-1], members[1:], strict=True)
    return links
