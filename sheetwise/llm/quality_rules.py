"""Quality rules per document, and verdicts on whole hosts.

Counts are taken over the whole text (words are runs of characters other than space and tab to
carriage return). Rule failures are summed per host. A host's failure rate of each rule is shrunk
towards the rate of all hosts with a beta prior, whose strength comes from the spread of the rates
between hosts (method of moments), so that a host with few documents is not judged by them alone.
A host with a shrunk rate of at least ``reject`` in some rule is rejected, and its verdict is
joined back to its documents.

The two passes share no state but the table of hosts, which is written out; its rejected rows are
broadcast only if their measured size allows, else the join is sorted and split where a host is hot.

Defined results:

* null text: all counts are 0, so the rule on short texts fails. The empty text is the same.
* very long texts are counted whole, each in one task. A host whose rate is exactly ``reject`` is rejected.
* null host: no host verdict, and the document does not count towards any host.
* repeated rows are judged alike, each counts. An empty table gives an empty result.
* other columns are kept as they are; the added column is ``measured`` (or what the caller names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.common import free_name, stored

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Rates of a host are shrunk by at least and at most so many documents of the prior.
PRIOR_DOCUMENTS = (1.0, 1000.0)


def _repeated_words(words: list[bytes]) -> int:
    """Words in windows of five words that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    seen, repeated = {}, np.zeros(n + 1, bool)
    either = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    for at in order[either].tolist():  # equal hashes are confirmed on the words
        first = seen.setdefault(tuple(words[at : at + WINDOW]), at)
        if first != at:
            repeated[first] = repeated[at] = True
    starts = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(starts, at, 1)
    np.add.at(starts, at + WINDOW, -1)
    return int((np.cumsum(starts) > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The counts named in ``MEASURES``."""
    data = (text or "").encode()
    words = data.split()  # bytes split at the six ASCII blanks only
    lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
    codes = np.frombuffer(data, np.uint8)
    characters = int(((codes & 0xC0) != 0x80).sum())
    return (
        len(words),
        characters - (len(data) - len(data.translate(None, SPACES))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeated_words(words),
    )


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measures(texts: pa.Array) -> pa.Array:
    rows = [measure_text(t.as_py()) for t in texts]
    table = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(c) for c in table.T], names=MEASURES)


def rule_failures(measured: str) -> dict[str, Column]:
    """What each rule rejects, by name; the first two judge single documents, too."""
    m = {name: F.col(f"{measured}.{name}") for name in MEASURES}
    return {
        "short": m["n_words"] < 10,
        "repetitive": 100 * m["n_repeat_words"] > 20 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > 3 * m["word_chars"],
        "lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
    }


def base_failed(measured: str) -> Column:
    rules = rule_failures(measured)
    return rules["short"] | rules["repetitive"]


def host_rates(measured_docs: DataFrame, measured: str, host: str) -> DataFrame:
    """Documents, failures and shrunk failure rate of each rule per host."""
    rules = rule_failures(measured)
    hosts = stored(
        measured_docs.filter(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(c).alias(f"{r}_failed") for r, c in rules.items()]),
        "hosts",
    )
    figures = []
    for r in rules:
        rate, n = F.col(f"{r}_failed") / F.col("docs"), F.sum("docs")
        mean = F.sum(f"{r}_failed") / n
        figures += [
            F.coalesce(mean, F.lit(0.0)).alias(f"{r}_mean"),
            F.coalesce(F.sum(F.col("docs") * rate * rate) / n - mean * mean, F.lit(0.0)).alias(f"{r}_spread"),
            F.coalesce(F.sum(rate * (1 - rate)) / n, F.lit(0.0)).alias(f"{r}_noise"),
        ]
    overall = hosts.agg(*figures).first()  # one row, whatever the number of hosts
    shrunk = {}
    for r in rules:
        mean = overall[f"{r}_mean"]
        between = max(overall[f"{r}_spread"] - overall[f"{r}_noise"], 1e-9)
        least, most = PRIOR_DOCUMENTS
        weight = min(max(mean * (1 - mean) / between - 1, least), most)
        shrunk[f"{r}_rate"] = (F.col(f"{r}_failed") + mean * weight) / (F.col("docs") + weight)
    return hosts.withColumns(shrunk)


def rejected_hosts(rates: DataFrame, reject: float) -> DataFrame:
    worst = F.greatest(*[F.col(c) for c in rates.columns if c.endswith("_rate")])
    return stored(rates.filter(worst >= reject).select("host"), "rejected_hosts")


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    reject: float = 0.9,
    measured: str = "measured",
) -> DataFrame:
    """All columns of ``docs``, the counts, base_failed and kept, in the struct ``measured``."""
    if measured in docs.columns:
        raise ValueError(f"{measured} is a column of the documents")
    counted = docs.withColumn(measured, measures(F.col(text)))
    rejected = rejected_hosts(host_rates(counted, measured, host), reject)
    mark = free_name(docs, "rejected_host")
    joined = counted.join(
        rejected.withColumnRenamed("host", mark), F.col(host) == F.col(mark), "left"
    )
    failed = base_failed(measured)
    judged = F.col(measured).withField("base_failed", failed).withField("kept", ~failed & F.col(mark).isNull())
    return joined.withColumn(measured, judged).drop(mark)


def quality_rules_stage(docs: DataFrame) -> DataFrame:
    """Documents that the rules keep, columns unchanged."""
    name = free_name(docs, "measured")
    return quality_rules(docs, measured=name).filter(F.col(f"{name}.kept")).select(docs.columns)
