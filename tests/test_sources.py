from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sheetwise.catalog.files import registry_tables
from sheetwise.functions import text
from sheetwise.functions.columns import ROW_ID
from sheetwise.operators.profile import _first_files, first_rows
from sheetwise.plans.cleaning_run import run_steps
from sheetwise.session import shared_folder
from sheetwise.sources import registry
from sheetwise.sources.inference import detect_dates, text_evidence
from sheetwise.sources.readers import header_names, read_csv, read_head, read_table
from sheetwise.sources.writers import write_table


def read(spark, tmp_path, text, **options):
    path = tmp_path / "in.CSV"
    path.write_text(text, encoding="utf-8")
    return read_table(spark, str(path), **options)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_types(spark, tmp_path):
    df = read(spark, tmp_path, (
        "i,f,b,s,mix,yn,suffix,sci,pad\n"
        "1,1.5,True,x,1,yes,1d,1e3, 12 \n"
        "2,,False,NA,a,no,2f,inf,+7\n"
        ",2,TRUE,null,2,yes,1d,.5,-8\n"
    ))
    assert dict(df.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "mix": "string",
        "yn": "string", "suffix": "string", "sci": "double", "pad": "bigint",
    }
    assert column(df, "i") == [1, 2, None] and column(df, "s") == ["x", None, None]
    assert column(df, "sci") == [1000.0, float("inf"), 0.5] and column(df, "pad") == [12, 7, -8]


def test_uploaded_sample(spark, tmp_path):
    df = read(spark, tmp_path, "col1,col2\n1,2\n3,4")
    assert [tuple(r) for r in df.collect()] == [(1, 2), (3, 4)]


def test_big_integers_become_double(spark, tmp_path):
    df = read(spark, tmp_path, "x\n1\n99999999999999999999\n")
    assert df.dtypes == [("x", "double")]


def test_dates_need_four_fifths_of_all_rows(spark, tmp_path):
    few = read(spark, tmp_path, "d,n\n2024-01-02,1\n02/03/2024,2\n2024-03-04,3\n,4\n")
    assert few.dtypes[0] == ("d", "string")
    rows = "".join(f"2024-01-{i:02d},1\n" for i in range(1, 10)) + "bad,1\n"
    many = read(spark, tmp_path, "d,n\n" + rows)
    assert many.dtypes[0] == ("d", "timestamp_ntz")
    assert column(many, "d")[0] == datetime(2024, 1, 1) and column(many, "d")[-1] is None


@pytest.mark.parametrize("text, wanted", [
    ("01/02/2024", datetime(2024, 1, 2)),
    ("25/12/2024", datetime(2024, 12, 25)),
    ("2024/3/4", datetime(2024, 3, 4)),
    ("4-3-2024", datetime(2024, 3, 4)),
    ("2024-01-02T03:04:05", datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02 03:04:05.25", datetime(2024, 1, 2, 3, 4, 5, 250000)),
])
def test_date_formats(spark, tmp_path, text, wanted):
    assert column(read(spark, tmp_path, f"d\n{text}\n"), "d") == [wanted]


def test_impossible_date_stays_text(spark, tmp_path):
    assert read(spark, tmp_path, "d\n2024-02-31\n").dtypes == [("d", "string")]


def test_quotes_and_line_breaks(spark, tmp_path):
    df = read(spark, tmp_path, 'a,b\n"say ""hi"", ok","two\nlines"\n', multi_line=True)
    assert tuple(df.first()) == ('say "hi", ok', "two\nlines")


def test_header_names():
    assert header_names(["a", None, "a", "a", "a.1"]) == ["a", "Unnamed: 1", "a.1", "a.2", "a.1.1"]


def test_header_case(spark, tmp_path):
    df = read(spark, tmp_path, "a,A\n1,x\n")
    assert df.columns == ["a", "A.1"] and tuple(df.first()) == (1, "x")
    assert header_names(["a", "A"], case_sensitive=True) == ["a", "A"]


def test_repeated_header(spark, tmp_path):
    df = read(spark, tmp_path, "a,a,b c\n1,x,2\n")
    assert df.dtypes == [("a", "bigint"), ("a.1", "string"), ("b c", "bigint")]
    assert tuple(df.first()) == (1, "x", 2)


def test_header_without_rows(spark, tmp_path):
    df = read(spark, tmp_path, "a,b\n")
    assert df.columns == ["a", "b"] and df.count() == 0


def test_unsupported(spark):
    with pytest.raises(ValueError, match="Unsupported file type: .xlsx"):
        read_table(spark, "/nowhere/a.xlsx")
    with pytest.raises(ValueError, match="Unsupported export format"):
        write_table(spark.range(1), "/nowhere/a.xlsx")


def test_rows_with_too_many_cells_fail(spark, tmp_path):
    schema = spark.createDataFrame([], "a string, b string").schema
    for long in ("1,2,3", "1,2,", '1,2,"x,y"', "1,2,,,5"):
        with pytest.raises(Exception, match="more than 2 cells"):
            read(spark, tmp_path, f"a,b\n1,2\n{long}\n")
        table = read_csv(spark, str(tmp_path / "in.CSV"), schema=schema)
        for rows in (table, table.select("a")):
            with pytest.raises(Exception, match="more than 2 cells"):
                rows.collect()
        with pytest.raises(Exception, match="more than 2 cells"):
            table.count()


def test_short_rows_are_filled(spark, tmp_path):
    df = read(spark, tmp_path, 'a,b,c\n1,2,x\n3\n4,\n5,6,\n,,\n7,8,"x,y"\n')
    rows = [(1, 2, "x"), (3, None, None), (4, None, None), (5, 6, None), (None, None, None), (7, 8, "x,y")]
    assert [tuple(r) for r in df.collect()] == rows
    assert df.count() == 6 and [r["a"] for r in df.select("a").collect()] == [r[0] for r in rows]


def test_line_breaks_inside_quotes(spark, tmp_path):
    one, two = 'a\n"x\ny"\nz\n', 'a,b\n1,"x\n\ny"\n2,z\n'
    assert [r["a"] for r in read(spark, tmp_path, one).collect()] == ["x\ny", "z"]
    df = read(spark, tmp_path, two)
    assert [tuple(r) for r in df.collect()] == [(1, "x\n\ny"), (2, "z")] and df.count() == 2
    for text in (one, two):
        with pytest.raises(ValueError, match="multi_line=True"):
            read(spark, tmp_path, text, multi_line=False)
    with pytest.raises(Exception, match="more than 2 cells"):
        read(spark, tmp_path, two + '3,"a\nb",c\n')


@pytest.mark.parametrize(
    ("cells", "wanted"),
    [
        (["2024-01-02 10:00", "2024-01-02 10:00:30"], "2024-01-02 10:00:00"),
        (["2024-01-02T10:00", "2024-01-02T10:00:30.5"], "2024-01-02 10:00:00"),
        (["2024-01-02T03:04:05Z", "2024-01-02 03:04+02:00"], "2024-01-02 03:04:05"),
        (["2024-01-02T03:04:05+05:30"], "2024-01-01 21:34:05"),
        (["1/2/2024 10:00:00", "1/13/2024 9:00"], "2024-01-02 10:00:00"),
        (["2/1/2024 10:00:00", "13/1/2024 10:00"], "2024-01-02 10:00:00"),
        (["02-Jan-2024", "3-MAR-2024"], "2024-01-02 00:00:00"),
    ],
)
def test_date_forms(spark, tmp_path, cells, wanted):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = read(spark, tmp_path, "d\n" + "\n".join(cells) + "\n")
        assert df.schema["d"].dataType.simpleString() == "timestamp_ntz"
        assert str(df.first()["d"]) == wanted
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_second_run_replaces_the_copy(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n1,"x\ny"\n2,z\n')
    steps = [{"operation": "remove_duplicates"}]
    for _ in range(2):
        path, report = run_steps(read_table(spark, str(tmp_path / "t.csv")), steps, str(tmp_path / "t.csv"))
        assert report.first()["resulting_rows"] == 2
        assert sorted(tuple(r) for r in read_table(spark, path).collect()) == [(1, "x\ny"), (2, "z")]
    again = read_table(spark, path)
    with pytest.raises(Exception, match="(?i)overwrite"):
        run_steps(again, steps, str(tmp_path / "t.csv"))
    assert again.count() == 2


def test_known_schema(spark, tmp_path):
    schema = spark.createDataFrame([], "a int, s string").schema
    path = tmp_path / "x.csv"
    path.write_text("a,s\n1,NA\nnull, y\n")
    df = read_csv(spark, str(path), schema=schema, row_id=True)
    assert [(r["a"], r["s"]) for r in df.collect()] == [(1, None), (None, " y")]
    assert [r["a"] for r in first_rows(df, 1).collect()] == [1]


def test_spaces_and_empty_cells_survive(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 1), (None, 2), ("b", 3)], "s string, n bigint")
    path = write_table(df, str(tmp_path / "o.csv"))
    assert sorted(read_table(spark, path).collect(), key=str) == sorted(df.collect(), key=str)


def test_first_rows_in_file_order(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(0, 100, 1, 9).write.parquet(path)
    by_id = [r["id"] for r in first_rows(read_table(spark, path, row_id=True), 20).collect()]
    assert by_id == [r["id"] for r in read_head(spark, path, 20).collect()] == list(range(20))
    assert read_head(spark, path, 500).count() == 100
    assert read_head(spark, path, 0).count() == 0


def test_first_rows_prune_files(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(0, 100, 1, 9).write.parquet(path)
    table = read_table(spark, path, row_id=True)
    assert len(_first_files(table, 5).select("id").inputFiles()) == 9  # listed, not read
    assert _first_files(table, 5).count() < 20
    assert _first_files(table.filter("id > 95"), 3).count() == 4
    assert [r["id"] for r in first_rows(table.filter("id > 90"), 3).collect()] == [91, 92, 93]


def test_row_id_of_csv_keeps_file_order(spark, tmp_path):
    df = read(spark, tmp_path, "a\n" + "\n".join(str(i) for i in range(50)) + "\n", row_id=True)
    assert ROW_ID in df.columns
    assert [r["a"] for r in first_rows(df, 5).collect()] == [0, 1, 2, 3, 4]


def test_nan_of_parquet_is_missing(spark, tmp_path, plan_of):
    path = str(tmp_path / "n.parquet")
    spark.createDataFrame([(float("nan"),), (9.0,), (None,)], "x double").write.parquet(path)
    assert read_table(spark, path).filter("x > 5").count() == 1
    plain = read_table(spark, path, nan_as_null=False).filter("x > 5")
    assert plain.count() == 2 and "GreaterThan(x,5.0)" in plan_of(plain)


def test_registry(spark, tmp_path):
    (tmp_path / "Sales.CSV").write_text("a\n1\n")
    (tmp_path / "b.parquet").write_bytes(b"123")
    found = registry.datasets(spark, str(tmp_path))
    row = registry.by_name(found, "Sales").first()
    assert (row["file_type"], row["file_size"], row["original_filename"]) == (".csv", 4, "Sales.CSV")
    assert registry.recent(found, 1).count() == 1
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    many = registry.by_name(registry.datasets(spark, f"file://{tmp_path}/"), "many").first()
    assert read_table(spark, many["file_path"]).count() == 10
    assert registry.by_path(found, many["file_path"]).count() <= 1
    users = spark.createDataFrame([(2, "e@x"), (1, "e@x")], "id int, email string")
    assert registry.first_match(users, "email", "e@x", "id").first()["id"] == 1


def test_shared_folder_comes_from_the_session(spark):
    class Context:
        def __init__(self, master, folder):
            self.master, self.folder = master, folder

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, folder, setting):
            self.sparkContext = Context(master, folder)
            self.conf = {"spark.checkpoint.dir": setting}

    assert shared_folder(Session("yarn", None, "hdfs:///shared")) == "hdfs:///shared"
    assert shared_folder(Session("yarn", "hdfs:///set", None)) == "hdfs:///set"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(Session(master, None, None))
    local = Session("local[2]", None, None)
    assert shared_folder(local) == local.sparkContext.getCheckpointDir()


def test_registry_lists_every_table(spark, tmp_path):
    for i in range(60):
        spark.range(i).coalesce(1).write.parquet(str(tmp_path / f"t{i:02}.parquet"))
    found = registry_tables(spark, str(tmp_path)).collect()
    assert [(r["name"], r["total_rows"]) for r in found] == [(f"t{i:02}", i) for i in range(60)]


def test_rows_of_a_registry_come_from_one_plan(spark, tmp_path):
    tmp_path = tmp_path / "a b%c+é"
    tmp_path.mkdir()
    for i in range(5):
        spark.range(i * 10).write.parquet(str(tmp_path / f"t{i}.parquet"))
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n2,z\n')
    (tmp_path / "b.csv").mkdir()
    for i in range(3):
        (tmp_path / "b.csv" / f"part{i}.csv").write_text("x\n" + "1\n" * i)
    counts = registry.row_counts(spark, str(tmp_path))
    found = {r["file_path"].rsplit("/", 1)[-1]: r["total_rows"] for r in counts.collect()}
    assert {k: found.get(k, 0) for k in ("t0.parquet", "t1.parquet", "t4.parquet", "a.csv", "b.csv")} == {
        "t0.parquet": 0, "t1.parquet": 10, "t4.parquet": 40, "a.csv": 2, "b.csv": 3,
    }
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 3


@pytest.mark.parametrize("written, wanted", [
    ("May 1 2024", "2024-05-01 00:00:00"), ("1 May 2024 10:00", "2024-05-01 10:00:00"), ("Sept. 30th, 2023", "2023-09-30 00:00:00"),
    ("Tuesday, December 31 1999 at 11:59:58.5 p.m.", "1999-12-31 23:59:58.500000"), ("12-February-2024 12:05 AM", "2024-02-12 00:05:00"),
    ("30 Feb 2024", None), ("May 1 2024 13:00 pm", None), ("Mai 1 2024", None), ("May 2024", None), ("1.12.2024", "2024-12-01 00:00:00"),
])
def test_free_dates(spark, written, wanted):
    df = spark.createDataFrame([(written,)] + [("2 June 2024" if "." != written[1] else "2.6.2024",)] * 9, "d string")
    found = detect_dates(df)
    assert dict(found.dtypes)["d"] == "timestamp_ntz"
    first = found.first()["d"]
    assert (None if first is None else str(first)) == wanted


def test_types_by_look_equal_types_by_value(spark):
    rng = random.Random(3)
    values = ["12", " 7 ", "+5", "-0", "9" * 18, "9" * 19, "9" * 25, "0" * 60 + "5", "1.5", ".5", "5.", "1e3", "1E-3", "inf", "-Infinity", "0x1",
              "1d", "True", "FALSE", "yes", "2024-01-02", "1/2/2024", "a1", "", "x" * 100, "1" + "0" * 70 + ".5", "e5", ".", "+", "é9", "\t3\n"]
    columns = [[rng.choice(values[: rng.choice([3, 9, 15, len(values)])]) for _ in range(40)] for _ in range(30)] + [[v] * 40 for v in values]
    df = spark.createDataFrame([tuple(c[i] for c in columns) for i in range(40)], ", ".join(f"c{i} string" for i in range(len(columns))))
    evidence = text_evidence(df, df.columns)
    for i, name in enumerate(df.columns):
        v = F.col(name)
        counts = df.agg(F.count(text.to_integer(v)), F.count(text.to_double(v)), F.count(text.to_boolean(v))).first()
        assert tuple(counts) == tuple(evidence[i][k] for k in ("bigint", "double", "boolean")), columns[i]
