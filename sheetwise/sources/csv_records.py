"""Records of CSV files with line breaks inside quotes, without giving up splits.

Whether a line begins inside a quoted cell depends on all lines before it, but a split can only begin
in one of two states. One pass gives, per split, the state behind it for either state in front, and whether a
record that was open in front is closed within. Put together in the order of the splits of a file, that
tells which splits begin inside quotes and in which split such a record began. A second pass then
frames the lines of every split into records by itself; only the pieces of records that span splits are
shuffled and joined. Cells are parsed by Spark's own `from_csv`.

Quotes count as a reader sees them: a quote opens a cell only at its beginning, a doubled quote inside
stands for itself, and what follows the closing quote up to the next comma belongs to the cell.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE, COMMA_QUOTE = b'"', b',"'
#: Stands for the block behind the last one of a file.
END = -1
SUMMARY = "file long, block long, from_outside boolean, from_inside boolean, closes boolean"
FRAMES = "file long, block long, part long, row long, header boolean, value binary, path string"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open behind the line."""
    at = 0
    if not inside:
        at = 1 if line[:1] == QUOTE else _next_quoted(line, 0)
        if at < 0:
            return False
    while True:
        at = line.find(QUOTE, at)
        if at < 0:
            return True
        if line[at + 1 : at + 2] == QUOTE:
            at += 2
            continue
        at = _next_quoted(line, at + 1)
        if at < 0:
            return False


def _next_quoted(line: bytes, at: int) -> int:
    """Behind the quote that opens the next quoted cell, -1 if there is none."""
    found = line.find(COMMA_QUOTE, at)
    return -1 if found < 0 else found + 2


def text_lines(spark: SparkSession, path: str | list[str], paths: bool = False, **options: str) -> DataFrame:
    """``file, block, line, path``: lines as bytes, with the split that they come from; the path only if wanted."""
    lines = spark.read.options(**options).text(path, lineSep="\n")
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
        (F.col("_metadata.file_path") if paths else F.lit(None).cast("string")).alias("path"),
    )


def _splits(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Runs of rows of one split."""
    file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
    changed = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for a, b in itertools.pairwise([0, *changed.tolist(), len(file)]):
        if b > a:
            yield (int(file[a]), int(block[a])), batch.slice(a, b - a)


def _quoted(lines: pa.Array) -> list[int]:
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, state = None, (False, True, False)

    def row() -> pa.RecordBatch:
        names = ["file", "block", "from_outside", "from_inside", "closes"]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*split, *state)], names=names)

    for batch in batches:
        for key, rows in _splits(batch):
            if key != split:
                if split is not None:
                    yield row()
                split, state = key, (False, True, False)
            outside, inside, closes = state
            lines = rows.column("line")
            for at in _quoted(lines):
                line = lines[at].as_py()
                same = outside == inside
                outside = ends_inside(line, outside)
                inside = outside if same else ends_inside(line, inside)
                closes = closes or not inside
            state = outside, inside, closes
    if split is not None:
        yield row()


def open_splits(lines: DataFrame) -> dict[tuple[int, int], int]:
    """(file, block) of the splits that begin inside quotes, and the block where that record began.

    A file that ends inside quotes has an entry for block ``END``. The driver gets one entry per such split at most.
    """
    summary = lines.select("file", "block", "line").mapInArrow(_summarise, SUMMARY)
    ordered = summary.groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("block", "from_outside", "from_inside", "closes"))).alias("splits")
    )
    kind = "struct<opener: bigint, found: array<struct<block: bigint, opener: bigint>>>"
    start = F.expr(f"cast(struct(null, array()) as {kind})")

    def step(done, split):
        opener, block = done["opener"], split["block"]
        still = F.when(opener.isNull(), split["from_outside"]).otherwise(split["from_inside"])
        behind = F.when(still, F.when(opener.isNull() | split["closes"], block).otherwise(opener))
        here = F.array(F.struct(block.alias("block"), opener.alias("opener")))
        found = F.when(opener.isNull(), done["found"]).otherwise(F.concat(done["found"], here))
        return F.struct(behind.alias("opener"), found.alias("found")).cast(kind)

    last = lambda done: F.when(done["opener"].isNull(), done["found"]).otherwise(
        F.concat(done["found"], F.array(F.struct(F.lit(END).alias("block"), done["opener"].alias("opener"))))
    )
    found = ordered.select("file", F.inline(F.aggregate("splits", start, step, last)))
    return {(r["file"], r["block"]): r["opener"] for r in found.collect()}


@dataclass
class _Split:
    """Records of one split as its lines come."""

    file: int
    block: int
    path: str | None
    opener: int | None
    held: list[bytes] = field(default_factory=list)
    rows: int = 0
    out: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self.inside = self.spans = self.opener is not None

    def _put(self, value: bytes, block: int, whole: bool) -> None:
        if whole and not value.strip():
            return  # blank lines are no records
        header = self.block == 0 and self.rows == 0
        part = None if whole else self.block
        self.out.append((self.file, block, part, self.block + self.rows, header, value, self.path))
        self.rows += 1

    def add(self, lines: list[bytes], quoted: list[int]) -> None:
        after = 0
        for at in quoted:
            self._plain(lines[after:at])
            self._quoted(lines[at])
            after = at + 1
        self._plain(lines[after:])

    def _plain(self, lines: list[bytes]) -> None:
        if self.inside:
            self.held += lines
        else:
            for line in lines:
                self._put(line, self.block, True)

    def _quoted(self, line: bytes) -> None:
        was, self.inside = self.inside, ends_inside(line, self.inside)
        if was or self.inside:
            self.held.append(line)
        else:
            self._put(line, self.block, True)
        if was and not self.inside:
            value, self.held = b"\n".join(self.held), []
            self._put(value, self.opener if self.spans else self.block, not self.spans)
            self.spans = False

    def end(self) -> None:
        if self.held:
            self._put(b"\n".join(self.held), self.opener if self.spans else self.block, False)


def _frame(openers: dict[tuple[int, int], int], whole: bool):
    """Whole records, or pieces of those that span splits."""

    def records(split: _Split) -> pa.RecordBatch:
        rows = [r for r in split.out if (r[2] is None) == whole]
        split.out = []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string())
        columns = zip(*rows, strict=True) if rows else ([],) * 7
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "part", "row", "header", "value", "path"])

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            for key, rows in _splits(batch):
                if split is None or key != (split.file, split.block):
                    if split is not None:
                        split.end()
                        yield records(split)
                    split = _Split(*key, rows.column("path")[0].as_py(), openers.get(key))
                lines = rows.column("line")
                split.add(lines.to_pylist(), _quoted(lines))
                yield records(split)
        if split is not None:
            split.end()
            yield records(split)

    return frame


def csv_records(spark: SparkSession, path: str | list[str], paths: bool = False, **options: str) -> DataFrame:
    """``file, row, header, value, path``: the text of every record of CSV files, line breaks inside quotes included.

    ``row`` grows in the order of a file and ``header`` marks its first record. Records end with a newline,
    a carriage return before it is left out; blank lines are no records. A quote that is never closed keeps
    the rest of the file in one record. The path is only given if wanted; ``options`` choose the files.
    """
    lines = text_lines(spark, path, paths, **options)
    openers = open_splits(lines)
    names = ["file", "row", "header", "value", "path"]
    found = lines.mapInArrow(_frame(openers, True), FRAMES).select(*names)
    if openers:
        pieces = lines.mapInArrow(_frame(openers, False), FRAMES)
        parts = F.transform(F.sort_array(F.collect_list(F.struct("part", "value"))), lambda p: p["value"].cast("string"))
        joined = pieces.groupBy("file", "block", "path").agg(
            F.min("row").alias("row"), F.bool_or("header").alias("header"), F.array_join(parts, "\n").cast("binary").alias("value")
        )
        found = found.unionByName(joined.select(*names))
    return found.withColumn("value", F.regexp_replace(F.col("value").cast("string"), "\r$", ""))


def record_counts(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """``path, total_rows``: records per CSV file without its header, for any number of files."""
    records = csv_records(spark, path, paths=True, **options)
    return records.groupBy("path").agg(F.count_if(~F.col("header")).alias("total_rows"))
