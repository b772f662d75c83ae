"""URL filter: allow and block rules on host and path, by a sort-merge range join.

A host is written with its labels reversed (``www.example.com`` becomes ``com.example.www.``), so
a rule fits exactly the hosts in one interval of keys: from ``com.example.`` up to ``com.example/``
(no host contains a slash). Pages and rules meet in buckets of the sorted key space. Bucket bounds
come from a sample of the keys; each key ends with a hash of the row, so that a host or even a url
with a third of all rows is cut into many buckets. A rule goes to the buckets that its interval
meets. Each bucket is swept in key order with a stack of the rules whose interval is open; these
are nested, because two intervals of prefixes are nested or apart. The longest fitting rule wins.

Defined results:

* null url, or no ``://``: host and path are empty; only rules for the empty host could fit.
* very long urls are judged whole.
* no rule fits: rule is null, verdict is ``default``.
* two rules of equal length fit: the one with the longer host wins, then ``block``.
* a rule listed twice counts once; if its verdicts differ, ``block`` wins. Rules with a null host
  are ignored, a null path is the empty path.
* repeated pages are judged alike, an empty table gives an empty result, and columns of ``pages``
  other than ``keep`` and ``url`` are not read, whatever their names.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.common import lower_ascii, partitions

SAMPLES_PER_BUCKET = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return lower_ascii(host), path


def host_key(host: Column) -> Column:
    """Labels in reverse, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _bucket_of(bounds: list[str]):
    def find(keys: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(bounds, k) for k in keys.to_pylist()], pa.int32())

    return F.arrow_udf(find, "int")


def _bounds(keys: DataFrame, buckets: int, rows: int) -> list[str]:
    """At most ``buckets - 1`` keys that cut the table evenly, from a sample of bounded size."""
    share = min(1.0, SAMPLES_PER_BUCKET * buckets / max(rows, 1))
    sample = sorted(r[0] for r in keys.sample(share, seed=1).collect())
    cuts = [sample[len(sample) * i // buckets] for i in range(1, buckets)] if sample else []
    return sorted(set(cuts))


class _Level:
    """Rules of one host: by path, tried from the longest length that occurs."""

    def __init__(self, prefix: str):
        self.prefix, self.paths, self.lengths = prefix, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.paths or verdict == "block":
            self.paths[path] = (rule, verdict)
            self.lengths = sorted({len(p) for p in self.paths}, reverse=True)

    def best(self, path: str):
        return next((self.paths[path[:n]] for n in self.lengths if path[:n] in self.paths), None)


def _sweep(batches):
    """Events in key order, rules before pages of the same key; open rules are on the stack."""
    bucket, stack = None, []
    for batch in batches:
        rules, verdicts = [], []
        columns = (batch.column(c).to_pylist() for c in ("bucket", "key", "path", "rule", "verdict"))
        for at, key, path, rule, verdict in zip(*columns, strict=True):
            if at != bucket:
                bucket, stack = at, []
            while stack and not key.startswith(stack[-1].prefix):
                stack.pop()
            if rule is not None:
                if not stack or stack[-1].prefix != key:
                    stack.append(_Level(key))
                stack[-1].add(path, rule, verdict)
                continue
            best = None
            for level in reversed(stack):  # longest host first
                found = level.best(path)
                if found and (best is None or len(found[0]) > len(best[0])):
                    best = found
            rules.append(best and best[0])
            verdicts.append(best and best[1])
        pages = batch.filter(batch.column("rule").is_null())
        yield pa.RecordBatch.from_arrays(
            [pages.column("kept"), pages.column("host"), pages.column("path"),
             pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
            names=["kept", "host", "path", "rule", "verdict"],
        )


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    default: str = "allow",
) -> DataFrame:
    """``keep``, host, path, rule and verdict of every page; ``rules(verdict, host, path)``."""
    if set(keep) & {"host", "path", "rule", "verdict"}:
        raise ValueError("host, path, rule and verdict are columns of the result")
    buckets = partitions(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    kept = F.struct(*[F.col(c) for c in keep])
    urls = pages.select(
        kept.alias("kept"), host.alias("host"), path.alias("path"),
        F.hex(F.xxhash64(*keep, url)).alias("salt"),
    ).withColumn("key", F.concat(host_key(F.col("host")), "path", F.lit("\0"), "salt"))
    bounds = _bounds(urls.select("key"), buckets, pages.count())
    bucket = _bucket_of(bounds)
    events = urls.select(
        bucket("key").alias("bucket"), "key", "path", "host", "kept",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    rule_path = F.coalesce("path", F.lit(""))
    rule_host = lower_ascii(F.col("host"))
    start = host_key(rule_host)
    opened = rules.filter(F.col("host").isNotNull()).select(
        start.alias("key"), rule_path.alias("path"), rule_host.alias("host"),
        F.concat(rule_host, rule_path).alias("rule"), "verdict",
        F.regexp_replace(start, r"\.\z", "/").alias("end"),
    )
    spread = opened.select(
        F.explode(F.sequence(bucket("key"), bucket("end"))).alias("bucket"), "key", "path", "host",
        F.lit(None).cast(events.schema["kept"].dataType).alias("kept"), "rule", "verdict",
    )
    ordered = (
        events.unionByName(spread)
        .repartitionByRange(buckets, "bucket")
        .sortWithinPartitions("bucket", "key", F.col("rule").asc_nulls_last())
    )
    result = T.StructType([events.schema["kept"], *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])
    return ordered.mapInArrow(_sweep, result).select(
        "kept.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
