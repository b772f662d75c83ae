"""Reading CSV and Parquet tables."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions.columns import ROW_ID, col, is_float, present
from sheetwise.functions.text import na_to_null
from sheetwise.operators.profile import first_rows
from sheetwise.sources.csv_records import csv_records
from sheetwise.sources.inference import infer_types

CSV_OPTIONS = {"escape": '"', "emptyValue": "", "nullValue": ""}
#: Stands behind the last cell of a row while its cells are counted.
END_MARK = "\x1eend\x1e"


def suffix_of(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


def read_table(spark: SparkSession, path: str, row_id: bool = False, **options) -> DataFrame:
    """Read a ``.csv`` or ``.parquet`` file or folder; any other suffix raises ValueError.

    With ``row_id`` the column ``_row_id`` (file, row) gives the position in the files.
    """
    readers = {".csv": read_csv, ".parquet": read_parquet}
    suffix = suffix_of(path)
    if suffix not in readers:
        raise ValueError(f"Unsupported file type: {suffix}")
    return readers[suffix](spark, path, row_id=row_id, **options)


def read_parquet(
    spark: SparkSession, path: str | list[str], row_id: bool = False, nan_as_null: bool = True
) -> DataFrame:
    """Read Parquet with NaN as missing, so that a filter treats both alike.

    Filters on float columns cannot reach the files through that step; set ``nan_as_null``
    to False for tables known to hold no NaN.
    """
    paths = [path] if isinstance(path, str) else path
    table = spark.read.parquet(*paths)
    if row_id:
        table = _with_row_id(table, F.col("_metadata.row_index"))
    if not nan_as_null or not any(is_float(f.dataType) for f in table.schema):
        return table
    return table.select(*[present(f).alias(f.name) for f in table.schema])


def read_csv(
    spark: SparkSession,
    path: str,
    row_id: bool = False,
    schema: T.StructType | None = None,
    detect_dates: bool = True,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read CSV with a header line, NA tokens as missing, and types found from the values.

    Finding types reads the text once more; pass ``schema`` to cast to known types instead.
    A pass over the lines finds out whether a quote is open at the end of one; if so, records are framed
    split by split (`csv_records`) instead of line by line. ``multi_line=True`` spares that pass,
    ``multi_line=False`` raises if there is such a line. A row with fewer
    cells than the header is filled with missing values, one with more raises, whichever columns
    are read.
    """
    broken = [] if multi_line else _open_quotes(spark, path)
    if broken and multi_line is False:
        raise ValueError(f"{path}: a quote is open at the end of a line ({broken[0]!r}); read with multi_line=True")
    framed = bool(multi_line or broken)
    if schema is None:
        header = spark.read.csv(path, header=False, multiLine=framed, **CSV_OPTIONS).first()
        if header is None:
            raise ValueError(f"No header line in {path}")
        exact = spark.conf.get("spark.sql.caseSensitive") == "true"
        names = header_names(list(header), exact)
    else:
        names = schema.names
    raw = free_name(names, "_raw_row")
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, raw]])
    if framed:
        table = _framed(spark, path, texts, raw, row_id)
    else:
        whole_rows = spark.read.option("columnPruning", False).option("columnNameOfCorruptRecord", raw)
        table = whole_rows.csv(path, schema=texts, header=True, **CSV_OPTIONS)
    table = table.filter(_not_too_long(col(raw), col(names[0]), len(names)))
    if row_id and not framed:
        table = _with_row_id(table, F.monotonically_increasing_id())
    kept = [ROW_ID] if row_id else []
    filled = {n: na_to_null(col(n)) for n in names}
    if schema is None:
        cleaned = table.select(*[v.alias(n) for n, v in filled.items()], *kept)
        return infer_types(cleaned, detect_dates)
    return table.select(*[filled[f.name].cast(f.dataType).alias(f.name) for f in schema], *kept)


def _framed(spark: SparkSession, path: str, texts: T.StructType, raw: str, row_id: bool) -> DataFrame:
    """Texts of all cells, from records that may hold line breaks."""
    records = csv_records(spark, path, paths=row_id).filter(~F.col("header"))
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in texts)
    cells = F.from_csv("value", ddl, {**CSV_OPTIONS, "columnNameOfCorruptRecord": raw, "maxCharsPerColumn": "-1"})
    position = F.struct(F.col("path").alias("file"), "row").alias(ROW_ID)
    parsed = records.select(cells.alias("cells"), *([position] if row_id else []))
    return parsed.select("cells.*", *([ROW_ID] if row_id else []))


def free_name(taken: list[str], name: str) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def _open_quotes(spark: SparkSession, path: str) -> list[str]:
    """The beginning of a line with an odd number of quotes, if there is one."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    return [r[0] for r in lines.filter(quotes % 2 == 1).limit(1).select(F.substring("value", 1, 60)).collect()]


def _not_too_long(raw: Column, first: Column, cells: int) -> Column:
    """True, or an error for a row with more cells than the header.

    The error names the first cell; Spark does not read ``raw`` without some other column. ``raw`` is the text of rows with a wrong number of cells, NULL for others. A mark put behind
    the row shows up among the first cells only if the row is not too long.
    """
    marked = F.from_csv(
        F.concat(raw, F.lit(f",{END_MARK}")),
        ", ".join(f"c{i} string" for i in range(cells + 1)),
        CSV_OPTIONS,
    )
    ends = reduce(lambda a, b: a | b, (marked[f"c{i}"].eqNullSafe(F.lit(END_MARK)) for i in range(cells + 1)))
    too_long = F.raise_error(
        F.concat(F.lit(f"A row has more than {cells} cells: "), F.substring(raw, 1, 200), F.lit(" begins with "), F.coalesce(first, F.lit("")))
    )
    return F.when(raw.isNull() | ends, F.lit(True)).otherwise(too_long.cast("boolean"))


def header_names(cells: list[str | None], case_sensitive: bool = False) -> list[str]:
    """Unique column names: blank ones get a number, repeated ones a suffix."""
    names: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(cells):
        name = cell or f"Unnamed: {i}"
        unique, copy = name, 0
        while (key := unique if case_sensitive else unique.lower()) in taken:
            copy += 1
            unique = f"{name}.{copy}"
        taken.add(key)
        names.append(unique)
    return names


def read_head(spark: SparkSession, path: str, n: int = 5, **options) -> DataFrame:
    """First n rows of a table in file order, reading only the files that hold them."""
    return first_rows(read_table(spark, path, row_id=True, **options), n)


def _with_row_id(table: DataFrame, row) -> DataFrame:
    position = F.struct(F.col("_metadata.file_path").alias("file"), row.alias("row"))
    return table.select("*", position.alias(ROW_ID))
