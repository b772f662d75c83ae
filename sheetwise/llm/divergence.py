"""How far the sources of a language differ in their words, and in which.

Terms are runs of ASCII letters (A-Z lower-cased) and of characters beyond ASCII. A language keeps the
terms that occur in at least ``MIN_DOCS`` of its documents. Every source, and the language as a whole,
gives each kept term a smoothed share in billionths, and two shares differ by (p - q)^2 / (p + q). All
of it is whole-number arithmetic: shares are divided out in thousandths, three times, so that no
product leaves 64 bits.

Most terms are missing in most sources, where the share is one constant per source. The sum over all kept terms
of a pair of sources is therefore the sum with both constants, plus what each source's own counts change
against the other's constant, plus a correction for terms that both have. These pair corrections
come from a frequent-pattern tree: a term is a path of its nonzero counts in the order of the sources,
equal paths are one row with a multiplicity, and the sorted rows of a task are inserted in a tree whose
nodes add up the multiplicities below. Each node meets each of its ancestors once, whatever the number
of terms that share the path.

Counting is combined inside each task before its shuffle, then by (language, source, term), so a
source or term with a third of all rows is spread over the tasks' sums. A term's row has at most one entry
per source. The table of pairs is the result asked for and as large as the squared number of sources of a language.

Defined results:

* null text, language and source are the empty string. Empty texts have no terms, but their group exists.
* very long texts are cut into parts at blanks and counted whole.
* repeated rows count as documents of their own.
* equal values of a group are ranked by the bytes of the item. An empty table gives an empty result.
* a language without kept terms has pairs of value 0; a group without terms has no rows of part ``term``.
* other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import partitions, stored

MIN_DOCS = 10
SMOOTHING = 2
TOP = 10
#: Sums that a task holds before it passes them on.
ENTRIES = 300_000
BYTES_AT_ONCE = 1 << 22
ROWS_AT_ONCE = 1 << 16
#: Tree nodes that a task holds.
NODES = 1 << 18
#: Lower-cased ASCII letters and bytes beyond ASCII as they are, all else a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in parts."""
    data, first = text.translate(TERM_BYTES), 0
    while len(data) - first > BYTES_AT_ONCE:
        last = data.find(b" ", first + BYTES_AT_ONCE)
        if last < 0:
            break
        yield data[first:last].split()
        first = last
    yield data[first:].split()


def _sums(sums: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, documents) in sums.items():
        terms = list(documents)
        for first in range(0, len(terms), ROWS_AT_ONCE):
            some = terms[first : first + ROWS_AT_ONCE]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(some), pa.string()),
                    "source": pa.array([source] * len(some), pa.string()),
                    "term": pa.array(some, pa.binary()).cast(pa.string()),
                    "n": pa.array([counts[t] for t in some], pa.int64()),
                    "docs": pa.array([documents[t] for t in some], pa.int64()),
                }
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per group and term; the null term stands for the group itself."""
    sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
            if (lang, source) not in sums:
                sums[lang, source] = Counter(), Counter()
            counts, documents = sums[lang, source]
            size -= len(documents)
            own: set[bytes | None] = {None}
            for words in _words(text.as_py()):
                counts.update(words)
                own.update(words)
            documents.update(own)
            size += len(documents)
            if size > ENTRIES:
                yield from _sums(sums)
                sums, size = {}, 0
    yield from _sums(sums)


def term_rows(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, total, items``: a row per kept term with its nonzero counts by source, in their order.

    The null term has all sources of the language as items, with count 0.
    """
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    summed = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = summed.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("items")
    )
    return rows.filter(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs")


def share(count: Column, size: Column) -> Column:
    """``1 + floor(10^9 * count / size)`` for ``0 <= count <= size``, null if ``size`` is 0."""
    size = F.nullif(size, F.lit(0))
    whole, rest = F.lit(0).cast("bigint"), count
    for _ in range(3):
        whole = whole * 1000 + F.call_function("div", rest * 1000, size)
        rest = (rest * 1000) % size
    return whole + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Tree:
    """Paths of one language, inserted in sorted order."""

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.own: list[int] = []
        self.items: list[tuple[str, int, int]] = []
        self.path: list[int] = []

    def insert(self, path: list[tuple[str, int, int]], multiplicity: int) -> None:
        shared = 0
        for node, item in zip(self.path, path):  # noqa: B905  the shorter one ends it
            if self.items[node] != item:
                break
            shared += 1
        del self.path[shared:]
        for item in path[shared:]:
            self.parent.append(self.path[-1] if self.path else -1)
            self.depth.append(len(self.path))
            self.own.append(0)
            self.items.append(item)
            self.path.append(len(self.items) - 1)
        self.own[self.path[-1]] += multiplicity

    def corrections(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Sources, and per pair of them (numbers ``a``, ``b``) the sum of corrections."""
        parent, depth = np.array(self.parent), np.array(self.depth)
        count = np.array(self.own, np.int64)
        for level in range(depth.max(), 0, -1):
            at = np.flatnonzero(depth == level)
            np.add.at(count, parent[at], count[at])
        names, source = np.unique([x[0] for x in self.items], return_inverse=True)
        share, zero = (np.array([x[k] for x in self.items], np.int64) for k in (1, 2))
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, up = np.arange(len(parent)), parent
        while True:
            at, up = at[up >= 0], up[up >= 0]
            if not len(at):
                return names.tolist(), keys // len(names), keys % len(names), sums
            p, q, zp, zq = share[at], share[up], zero[at], zero[up]
            value = count[at] * (_apart(p, q) - _apart(p, zq) - _apart(zp, q) + _apart(zp, zq))
            all_keys = np.r_[keys, source[up] * len(names) + source[at]]
            all_sums = np.r_[sums, value]
            keys, place = np.unique(all_keys, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, all_sums)
            up = parent[up]


def _pair_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(lang: str, tree: _Tree) -> pa.RecordBatch:
        names, a, b, value = tree.corrections()
        own = [[lang] * len(a), [names[i] for i in a], [names[i] for i in b], value]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(own, kinds, strict=True)], names=["lang", "a", "b", "value"])

    lang, tree = None, _Tree()
    for batch in batches:
        for own, path, multiplicity in zip(*(batch.column(c) for c in ("lang", "path", "multiplicity")), strict=True):
            if tree.items and (own.as_py() != lang or len(tree.items) > NODES):
                yield done(lang, tree)
                tree = _Tree()
            lang = own.as_py()
            tree.insert([(x["source"], x["p"], x["zero"]) for x in path.as_py()], multiplicity.as_py())
    if tree.items:
        yield done(lang, tree)


def pair_corrections(paths: DataFrame) -> DataFrame:
    """``lang, a, b, value`` from ``lang, path, multiplicity``: what the common terms of two sources change."""
    dealt = paths.repartitionByRange(partitions(paths.sparkSession), "lang", "path").sortWithinPartitions("lang", "path")
    return dealt.mapInArrow(_pair_corrections, "lang string, a string, b string, value long")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources, and terms used more than elsewhere."""
    terms = stored(term_rows(docs, min_docs), "terms")
    langs = terms.groupBy("lang").agg(F.count("term").alias("kept"), F.sum("total").alias("lang_size"))
    counts = terms.select("lang", "term", "total", F.inline("items"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    room = F.lit(SMOOTHING).cast("bigint") * F.col("kept")
    groups = stored(
        sizes.join(langs, "lang").withColumn("zero", share(F.lit(SMOOTHING).cast("bigint"), F.col("size") + room)), "groups"
    )
    shares = (
        counts.filter("term IS NOT NULL")
        .join(groups, ["lang", "source"])
        .withColumn("p", share(F.col("n") + SMOOTHING, F.col("size") + room))
    )
    return _term_part(shares, room, top).unionByName(_pair_part(shares, groups))


def _term_part(shares: DataFrame, room: Column, top: int) -> DataFrame:
    q = share(F.col("total") + SMOOTHING, F.col("lang_size") + room)
    more = shares.withColumn("q", q).filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pair_part(shares: DataFrame, groups: DataFrame) -> DataFrame:
    others = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    zero, other_zero = F.col("zero"), F.col("other_zero")
    base = groups.join(others, "lang").filter("source < other").select(
        "lang", F.col("source").alias("a"), F.col("other").alias("b"),
        (F.col("kept") * F.coalesce(apart(zero, other_zero), F.lit(0))).alias("value"),
    )
    counted = shares.groupBy("lang", "source", "zero", "p").agg(F.count(F.lit(1)).alias("multiplicity"))
    alone = counted.join(others, "lang").filter("source <> other").select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"),
        (F.col("multiplicity") * (apart(F.col("p"), other_zero) - apart(zero, other_zero))).alias("value"),
    )
    paths = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("path"))
    paths = stored(paths.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("multiplicity")), "paths")
    sums = base.unionByName(alone).unionByName(pair_corrections(paths)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = sums.select("lang", F.inline(both), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
