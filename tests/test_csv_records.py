"""Records of CSV files over many splits, against Python's reader."""

from __future__ import annotations

import csv
import io
import random

import pytest

from sheetwise.sources import csv_records
from sheetwise.sources.readers import read_csv, read_head


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cell(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.5:
        return rng.choice(["plain", "12", 'inch 5" x', "é", " padded ", "a'b"])
    words = ["line", "\n", '"', ",", "\n\n", '""', "x" * rng.randint(0, 60), 'say "hi",\n', "\r\n", "end"]
    return "".join(rng.choice(words) for _ in range(rng.randint(1, 9)))


def written(rng: random.Random, rows: int, end: str = "\n") -> tuple[str, list[list[str]]]:
    table = [["id", "first cell", "second"]]
    for i in range(rows):
        table.append([str(i), cell(rng), cell(rng) if rng.random() < 0.97 else "long\n" * 700 + "z"])
    out = io.StringIO()
    for row in table:
        cells = [f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ",\n\r") or c[:1] == '"' else c for c in row]
        out.write(",".join(cells) + end + (end if rng.random() < 0.05 else ""))
    return out.getvalue(), table[1:]


@pytest.mark.parametrize("seed, end", [(1, "\n"), (3, "\r\n")])
def test_records_over_many_splits(spark, tmp_path, small_splits, seed, end):
    rng, wanted = random.Random(seed), []
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for i in range(2):
        text, rows = written(rng, 150, end)
        (folder / f"part{i}.csv").write_bytes(text.encode())
        wanted += rows
    lines = csv_records.text_lines(spark, str(folder))
    openers = csv_records.open_splits(lines)
    assert lines.rdd.getNumPartitions() > 15 and len(openers) > 5
    assert any(block - opener > 1500 for (_, block), opener in openers.items())  # records over several splits
    found = [r["value"] for r in csv_records.csv_records(spark, str(folder)).filter("not header").collect()]
    parsed = [next(csv.reader(io.StringIO(v, newline=""), strict=False)) for v in found]
    assert sorted(parsed) == sorted(wanted)
    table = read_csv(spark, str(folder), detect_dates=False)
    assert sorted((r["id"], r["second"]) for r in table.collect()) == sorted((int(r[0]), r[2]) for r in wanted)
    counts = csv_records.record_counts(spark, str(folder)).collect()
    assert [r["total_rows"] for r in counts] == [150] * 2


def test_one_quoted_break_leaves_the_splits(spark, tmp_path, small_splits):
    path = tmp_path / "long.csv"
    path.write_text("a,b\n" + "1,x\n" * 6000 + '2,"two\nlines"\n' + "3,y\n" * 3000)
    table = read_csv(spark, str(path))
    assert table.rdd.getNumPartitions() > 20
    assert table.count() == 9001 and table.filter("b = 'two\nlines'").count() == 1
    head = read_head(spark, str(path), 3)
    assert [tuple(r) for r in head.collect()] == [(1, "x")] * 3


def test_positions_follow_the_file(spark, tmp_path, small_splits):
    path = tmp_path / "order.csv"
    path.write_text("n,t\n" + "".join(f'{i},"a\n{"b" * (i % 97)}"\n' for i in range(400)))
    rows = read_csv(spark, str(path), row_id=True).orderBy("_row_id").collect()
    assert [r["n"] for r in rows] == list(range(400))
    assert len({r["_row_id"] for r in rows}) == 400 and rows[0]["_row_id"]["file"].endswith("order.csv")


def test_short_long_and_unclosed_rows(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text('a,b,c\n1\n2,"x\ny"\n3,"z",w\n')
    assert [tuple(r) for r in read_csv(spark, str(path)).orderBy("a").collect()] == [(1, None, None), (2, "x\ny", None), (3, "z", "w")]
    path.write_text('a,b\n1,"x\ny",too long\n')
    with pytest.raises(Exception, match="more than 2 cells"):
        read_csv(spark, str(path)).collect()
    path.write_text('a,b\n1,x\n2,"never closed\n3,y\n')
    assert read_csv(spark, str(path)).count() == 2
    path.write_text('a,b\n1,5" pipe\n2,y\n')
    assert [tuple(r) for r in read_csv(spark, str(path)).orderBy("a").collect()] == [(1, '5" pipe'), (2, "y")]


def test_line_states():
    ends = csv_records.ends_inside
    assert ends(b'a,"b', False) and ends(b'"', False) and ends(b'"a"",', False) and ends(b"plain", True)
    assert not ends(b'a"b,c', False) and not ends(b'"a""b",c', False) and not ends(b'x",y', True) and not ends(b'"x"y,z"', False)
    assert ends(b'x",y,"z', True) and ends(b'""', True) and not ends(b'"', True)
