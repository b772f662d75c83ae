"""Whole-table documents: analysis, context, key figures, chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.columns import data_fields
from sheetwise.functions.records import record
from sheetwise.operators import profile as profiles
from sheetwise.operators import quality as qualities
from sheetwise.operators import stats
from sheetwise.operators.schema import classify, column_classes
from sheetwise.plans.shared_pass import count_all

#: Messages of a conversation that a chat call passes on.
HISTORY = 6
SAMPLE_ROWS = 20
CONTEXT_LABELS = 10


def analyze(df: DataFrame) -> dict[str, DataFrame]:
    """Column classes, statistics per class, correlation and summary.

    One pass counts labels, buckets of numbers, dates and rows (`shared_pass`); the quantiles and the
    correlation read the numeric columns once more each. Needs no `persist`.
    """
    counts = count_all(df)
    return {
        "columns": column_classes(df),
        "categorical_statistics": counts.value_counts(),
        "numeric_statistics": stats.numeric_stats(df, counted=counts.buckets()),
        "correlation_matrix": stats.correlation(df, centres=counts.centres()),
        "datetime_statistics": counts.datetime_stats(),
        "dataset_summary": qualities.dataset_summary(df, qualities.quality(df, counts.rows())),
    }


def _listed(part: DataFrame, order: list[str], *values: str) -> Column:
    """The rows of a small result as one sorted array, by scalar subquery."""
    entry = F.struct(*order, *[v for v in values if v not in order])
    kept = F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(*[e[v].alias(v) for v in values]))
    return part.agg(kept.alias("rows")).scalar()


def build_context(df: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """One row that describes the table: counts, types, statistics, top labels, a sample.

    Its size depends on the number of columns only: ten labels per text column and twenty
    sample rows. Give ``head`` (from `read_head`) to spare the scan for the first rows.
    """
    fields = data_fields(df)
    counts = count_all(df, whole_labels=False, duplicates=False, bool_as_numeric=True)
    numbers = stats.context_stats(df, counted=counts.buckets())
    pairs = stats.correlation(df, bool_as_numeric=True, centres=counts.centres())
    labels = stats.top_categories(df, CONTEXT_LABELS, counted=counts.labels())
    sample = profiles.first_rows(df, SAMPLE_ROWS) if head is None else head
    types = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
            for f in fields
        ]
    )
    return df.sparkSession.range(1).select(
        counts.rows().select("total_rows").scalar().alias("total_rows"),
        F.lit(len(fields)).alias("total_columns"),
        F.array(*[F.lit(f.name) for f in fields]).alias("column_names"),
        types.alias("column_types"),
        _listed(numbers, ["position"], "column", "mean", "median", "min", "max", "std").alias(
            "numeric_statistics"
        ),
        _listed(counts.missing(), ["position"], "column", "missing", "missing_pct").alias("missing_values"),
        _listed(pairs, ["col_a", "col_b"], "col_a", "col_b", "corr").alias("correlation_matrix"),
        _listed(labels, ["column", "position"], "column", "label", "count").alias("top_categories"),
        _in_order(sample).alias("sample"),
    )


def _in_order(sample: DataFrame) -> Column:
    """Records of a few rows, in the order of the rows."""
    numbered = sample.select(record(sample).alias("record"), F.monotonically_increasing_id().alias("at"))
    listed = F.sort_array(F.collect_list(F.struct("at", "record")))
    return numbered.agg(F.transform(listed, lambda r: r["record"]).alias("rows")).scalar()


def context_json(df: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """The context as one JSON text."""
    context = build_context(df, head)
    return context.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("context"))


def kpi_table(df: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """Key figures of the report: (kpi, value)."""
    found = classify(df, bool_as_numeric=True)
    rated = qualities.quality(df) if rated is None else rated
    figures = {
        "total_rows": F.col("total_rows").cast("string"),
        "total_columns": F.col("total_columns").cast("string"),
        "quality_score": F.concat(F.col("quality_score").cast("string"), F.lit("/100")),
        "numeric_columns": F.lit(str(len(found["numeric"]))),
        "categorical_columns": F.lit(str(len(found["categorical"]))),
    }
    return _kpis(rated, figures)


def kpi_cards(df: DataFrame) -> DataFrame:
    """Key figures of the dashboard: rows, columns, quality score, estimated data bytes."""
    size = profiles.dataset_size(profiles.profile(df)).select("data_bytes").scalar()
    figures = {
        "total_rows": F.col("total_rows").cast("string"),
        "total_columns": F.col("total_columns").cast("string"),
        "quality_score": F.concat(F.col("quality_score").cast("string"), F.lit("/100")),
        "data_bytes": F.col("data_bytes").cast("string"),
    }
    return _kpis(qualities.quality(df).withColumn("data_bytes", size), figures)


def _kpis(row: DataFrame, figures: dict[str, Column]) -> DataFrame:
    entries = [F.struct(F.lit(k).alias("kpi"), v.alias("value")) for k, v in figures.items()]
    return row.select(F.inline(F.array(*entries)))


def last_turns(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", n: int = HISTORY
) -> DataFrame:
    """The last n messages of every conversation.

    Rank limits are applied before the shuffle, so a long conversation sends at most n rows
    per task.
    """
    latest = Window.partitionBy(conversation).orderBy(F.desc(turn))
    ranked = messages.withColumn("_rank", F.row_number().over(latest))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def warnings(df: DataFrame) -> DataFrame:
    """Quality rules that fire for the table."""
    return qualities.recommendations(qualities.quality(df))
