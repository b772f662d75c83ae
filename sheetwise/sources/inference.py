"""Column types and dates found from text: one job for all columns, and one for those that look like dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import text
from sheetwise.functions.columns import ROW_ID, chunks, col, is_text

#: Share of all rows (blanks included) that must parse for a text column to become a date.
DATE_SHARE = 0.8
#: Columns and formats that are parsed in one aggregate.
FORMATS_AT_ONCE = 20


def text_evidence(df: DataFrame, columns: list[str]) -> list[dict | None]:
    """Per column: rows, filled values, and how many of them fit each type and date format.

    Values are counted by their look (`text.look`), of which a column has few, and types and formats are tried
    on the looks. Only values whose look leaves a type open are tried themselves. A second job counts what parses of the
    columns that look like dates, by the formats that their looks allow.
    """
    cells = F.array(
        *[F.struct(F.lit(i).alias("c"), col(name).alias("v")) for i, name in enumerate(columns)]
    )
    v, look, n = F.col("v"), F.col("look"), F.col("n")
    unclear = look.isNull() | (F.char_length("v") > text.SAFE_DIGITS)
    powers = look.isNull() | (F.contains(look, F.lit("a")) & (F.substring(look, 1, 1) != "a"))
    looks = df.select(F.inline(cells)).withColumn("look", text.look(v)).groupBy("c", "look").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(v).alias("n"),
        F.count(F.when(unclear, text.to_integer(v))).alias("integers"),
        F.count(F.when(~unclear, F.lit(1))).alias("short"),
        F.count(F.when(powers, text.to_double(v))).alias("powers"),
        F.count(text.to_boolean(v)).alias("boolean"),
    )
    integer = F.when(look.isNull(), F.col("integers")).when(look.rlike(text.INTEGER_LOOK), F.col("short") + F.col("integers"))
    double = F.when(look.rlike(text.DOUBLE_LOOK), n).otherwise(F.col("powers"))
    formats = range(len(text.DATE_FORMATS))
    total = lambda count: F.coalesce(F.sum(count), F.lit(0))
    found = looks.groupBy("c").agg(
        F.sum("rows").alias("rows"),
        F.sum("n").alias("filled"),
        total(integer).alias("bigint"),
        total(double).alias("double"),
        F.sum("boolean").alias("boolean"),
        *[total(F.when(look.rlike(text.date_look(i)), n)).alias(f"date{i}") for i in formats],
    )
    by_column = {row["c"]: row.asDict() for row in found.collect()}
    _count_dates(df, columns, by_column)
    return [by_column.get(i) for i in range(len(columns))]


def _count_dates(df: DataFrame, columns: list[str], evidence: dict[int, dict]) -> None:
    """Replace the number of values that look like a format by the number that parse, 0 if they are too few anyway."""
    wanted = []
    for c, row in evidence.items():
        typed = row["filled"] in (row["bigint"], row["double"], row["boolean"])
        for i in range(len(text.DATE_FORMATS)):
            if not typed and row[f"date{i}"] / max(row["rows"], 1) >= DATE_SHARE:
                wanted.append((c, i))
            else:
                row[f"date{i}"] = 0
    if not wanted:
        return
    # parsing costs many times what a hash aggregate does, and dates repeat: equal texts are parsed once
    cells = [F.struct(F.lit(c).alias("c"), col(columns[c]).alias("v")) for c in sorted({c for c, _ in wanted})]
    values = df.select(F.inline(F.array(*cells))).filter(F.char_length("v") <= text.LONGEST_LOOK)
    distinct = values.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    parsed = [
        F.coalesce(F.sum(F.when((F.col("c") == c) & text.to_timestamp(F.col("v"), text.DATE_FORMATS[i][0]).isNotNull(), F.col("n"))), F.lit(0))
        for c, i in wanted
    ]
    for part, own in zip(chunks(parsed, FORMATS_AT_ONCE), chunks(wanted, FORMATS_AT_ONCE), strict=True):
        for (c, i), count in zip(own, distinct.agg(*part).first(), strict=True):
            evidence[c][f"date{i}"] = count


def date_format_of(evidence) -> str | None:
    """Format that parses most values (first in the list on a tie), if it parses enough."""
    if evidence is None:
        return None
    fits = [evidence[f"date{i}"] for i in range(len(text.DATE_FORMATS))]
    best = max(range(len(fits)), key=lambda i: (fits[i], -i))
    enough = fits[best] / max(evidence["rows"], 1) >= DATE_SHARE
    return text.DATE_FORMATS[best][0] if enough else None


def typed_value(name: str, evidence, detect_dates: bool) -> Column:
    """The text column as the narrowest type that loses no value; dates by share."""
    value = col(name)
    if evidence is None or evidence["filled"] == 0:
        return value.cast("double")
    filled = evidence["filled"]
    if evidence["bigint"] == filled:
        return text.to_integer(value)
    if evidence["double"] == filled:
        return text.to_double(value)
    if evidence["boolean"] == filled:
        return text.to_boolean(value)
    date_format = date_format_of(evidence) if detect_dates else None
    return text.to_timestamp(value, date_format) if date_format else value


def infer_types(df: DataFrame, detect_dates: bool = True) -> DataFrame:
    """Type every text column: integer, double, boolean, timestamp or text."""
    columns = [f.name for f in df.schema.fields if is_text(f.dataType)]
    evidence = dict(zip(columns, text_evidence(df, columns), strict=True)) if columns else {}
    return df.select(
        *[
            typed_value(n, evidence[n], detect_dates).alias(n) if n in evidence else col(n)
            for n in df.columns
        ]
    )


def detect_dates(df: DataFrame) -> DataFrame:
    """Replace text columns whose values are dates; values that do not parse become missing."""
    columns = [f.name for f in df.schema.fields if is_text(f.dataType) and f.name != ROW_ID]
    if not columns:
        return df
    formats = dict(zip(columns, map(date_format_of, text_evidence(df, columns)), strict=True))
    return df.select(
        *[
            text.to_timestamp(col(n), formats[n]).alias(n) if formats.get(n) else col(n)
            for n in df.columns
        ]
    )
