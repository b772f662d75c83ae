"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words, punctuation runs, pairs of neighbours, beginnings
of words) give the weight of each bucket: the log ratio of its rate in target texts and in raw
texts, shrunk towards equal rates. The raw model counts all documents. The target model counts
documents labelled good and not toxic, from at most ``LABELS`` labelled rows; the other half of
these rows calibrates a document's evidence into the probability that it is a target document.
That is its importance weight. Gumbel top-k then samples: each document's log weight, sharpened,
gets Gumbel noise drawn from a hash of the row, and the k largest are kept, k being the expected
number of target documents in the corpus. The k-th value is found by counting values in bins, ever
finer, so no sort of the corpus and no list of documents is needed.

Counts are combined in each task; the models have a fixed number of buckets, whatever the corpus.

Defined results:

* very long texts: all n-grams of the text are counted, in one task.
* null and empty text: no n-grams; judged by the calibration's intercept.
* repeated rows have the same noise and are kept or dropped together, so ties at the k-th value may
  keep a few more than k.
* several labels of one document: it is a target only if all say so. Null labels are left out.
* no target among the labels: every document is kept, with weight 0. An empty table stays empty.
* other columns are kept as they are; the result is one struct column that the caller names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.common import free_name, stored

BUCKETS_LOG = 18
BUCKETS = 1 << BUCKETS_LOG
LABELS = 20_000
#: Pseudo-count of each bucket; evidence below this log ratio is left out.
PSEUDO, LEAST = 2.0, 1.5
SHARPNESS = 4.0
SEED = 11
PREFIXES = (4, 5, 6, 7)
FEATURES = ("against", "against_share", "mean", "worst", "length")

#: Bytes of texts that are hashed at once.
PIECE_BYTES = 1 << 20
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BACK = np.uint64(pow(int(ODD), -1, 1 << 64))
#: What a byte is: 0 blank, 1 part of a word, 2 punctuation; bytes beyond ASCII are taken for letters.
KIND = np.array([0 if chr(b).isspace() else 1 if b > 127 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], np.uint8)
UPPER = np.array([65 <= b <= 90 for b in range(256)])
BYTE_HASH = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)
BYTE_HASH[UPPER] = BYTE_HASH[np.flatnonzero(UPPER) + 32]  # case does not count


class Grams:
    """N-grams of some texts: groups of buckets, each with the text that a bucket belongs to."""

    def __init__(self, texts: list[str]):
        parts = [t.encode() + b"\n" for t in texts]
        codes = np.frombuffer(b"".join(parts), np.uint8)
        ends_of = np.cumsum([len(p) for p in parts])
        kind = KIND[codes]
        bounds = np.r_[0, np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(codes)]
        word = kind[bounds[:-1]]
        start, end, word = bounds[:-1][word > 0], bounds[1:][word > 0], word[word > 0]
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(codes), ODD)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(codes), BACK)])
        sums = np.r_[np.uint64(0), np.cumsum(BYTE_HASH[codes] * power[:-1])]
        upper = np.r_[0, np.cumsum(UPPER[codes])]
        owner = np.searchsorted(ends_of, start, "right")
        first, shift = sums[start], back[start]
        tokens = (sums[end] - first) * shift
        length = end - start
        self.groups = [(tokens, owner)]
        for n in PREFIXES:
            long = np.flatnonzero((length > n) & (word == 1))
            self.groups.append((((sums[start[long] + n] - first[long]) * shift[long]) ^ np.uint64(n), owner[long]))
        capital = np.flatnonzero((upper[end] - upper[start] == length) & (length > 1))
        self.groups.append((np.full(len(capital), 1, np.uint64), owner[capital]))
        near = np.flatnonzero(owner[1:] == owner[:-1])
        self.groups.append((tokens[near] * ODD + tokens[near + 1], owner[near]))
        self.groups = [(((h ^ (h >> np.uint64(29))) * MIX >> np.uint64(64 - BUCKETS_LOG)).astype(np.int64), o) for h, o in self.groups]


def pieces(texts: list[str | None]):
    """Parts of a list of texts, of about ``PIECE_BYTES`` each, and where each begins."""
    begin = size = 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if size >= PIECE_BYTES or at == len(texts) - 1:
            yield begin, [t or "" for t in texts[begin : at + 1]]
            begin, size = at + 1, 0


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("target").to_numpy(zero_copy_only=False)
        for begin, texts in pieces(batch.column("text").to_pylist()):
            wanted = good[begin : begin + len(texts)]
            for buckets, owner in Grams(texts).groups:
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[wanted[owner]], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])


def bucket_weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    expected = raw * (target.sum() / max(1, raw.sum()))
    return np.log((target + PSEUDO) / (expected + PSEUDO))


def evidence(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """What the bucket weights say about each text, as named in ``FEATURES``."""
    rows = np.zeros((len(texts), len(FEATURES)))
    for begin, part in pieces(texts):
        size = len(part)
        against, total, count, worst = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size)
        for buckets, owner in Grams(part).groups:
            if not len(buckets):
                continue
            found = weights[buckets]
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            of = owner[heads]
            total[of] += np.add.reduceat(found, heads, dtype=np.float64)
            count[of] += np.diff(np.r_[heads, len(found)])
            worst[of] = np.minimum(worst[of], np.minimum.reduceat(found, heads))
            against[of] += np.add.reduceat(np.where(found < -LEAST, found, 0), heads, dtype=np.float64)
        values = [np.log1p(-against), against / (count + 10), total / np.maximum(count, 1), worst, np.log1p(count)]
        rows[begin : begin + size] = np.stack(values, axis=1)
    return rows


def calibrate(features: np.ndarray, target: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression on standardised features; returns weights and intercept for raw ones."""
    mean, spread = features.mean(0), features.std(0) + 1e-9
    x = np.c_[(features - mean) / spread, np.ones(len(features))]
    ridge = np.r_[np.full(x.shape[1] - 1, 0.1), 1e-6]

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(target > 0, -1, 1) * (x @ w)).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (target - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6), slope)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w += size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return np.r_[w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum()]


def labelled_rows(labels: DataFrame) -> DataFrame:
    """At most ``LABELS`` labelled documents: ``labelled_id, target, fold``."""
    usable = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    one = usable.groupBy(F.col("doc_id").alias("labelled_id")).agg(
        F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("target")
    )
    chosen = one.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(LABELS)
    return stored(chosen.withColumn("fold", F.pmod(F.xxhash64("labelled_id", F.lit(SEED)), F.lit(2))), "labelled")


def _evidence_of(weights: np.ndarray, fitted: np.ndarray | None = None):
    if fitted is None:
        kind = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])

        def features(texts: pa.Array) -> pa.Array:
            rows = evidence(texts.to_pylist(), weights)
            return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=FEATURES)

        return F.arrow_udf(features, kind)

    def log_weight(texts: pa.Array) -> pa.Array:
        rows = evidence(texts.to_pylist(), weights)
        odds = np.clip(rows @ fitted[:-1] + fitted[-1], -30, 30)
        return pa.array(-np.log1p(np.exp(-odds)), pa.float64())

    return F.arrow_udf(log_weight, T.DoubleType())


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """Exact k-th largest value of a column without nulls, 1 <= k <= rows."""
    value = F.col(column)
    low, high = values.agg(F.min(value), F.max(value)).first()
    above = 0
    while True:
        inside = values.filter(value.between(low, high))
        width = (high - low) / bins
        if not width > 0 or low + width == low:  # a few neighbouring doubles are left
            for found, n in sorted(inside.groupBy(column).count().collect(), reverse=True):
                above += n
                if above >= k:
                    return found
        at = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
        counts = inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for row in sorted(counts.collect(), key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        if row["low"] == row["high"]:
            return row["low"]
        if row["n"] <= bins:
            held = values.filter(value.between(row["low"], row["high"])).select(column).collect()
            return sorted((r[0] for r in held), reverse=True)[k - above - 1]
        low, high = row["low"], row["high"]


class Resampler:
    """Fitted models; ``scored`` adds ``log_weight`` and ``perturbed`` as a struct column."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        known = labelled_rows(labels)  # at most LABELS rows, so it may be broadcast
        self.docs = docs
        self.weights = self.fitted = None
        texts = docs.select(F.col("doc_id").alias("id"), "text")
        if known.filter("target").isEmpty():
            return
        good = F.broadcast(known.filter("target and fold = 0").select("labelled_id"))
        marked = texts.join(good, F.col("id") == F.col("labelled_id"), "left").select(
            "text", F.col("labelled_id").isNotNull().alias("target")
        )
        counts = (
            marked.mapInArrow(_count, "bucket bigint, raw bigint, target bigint")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
            .toArrow()
        )
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        at = counts.column("bucket").to_numpy()
        raw[at], target[at] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
        self.weights = bucket_weights(raw, target).astype(np.float32)
        held = F.broadcast(known.filter("fold = 1"))
        checked = texts.join(held, F.col("id") == F.col("labelled_id")).select(
            "target", _evidence_of(self.weights)("text").alias("e")
        ).select("target", "e.*").toArrow()
        features = np.stack([checked.column(f).to_numpy() for f in FEATURES], axis=1)
        self.fitted = calibrate(features, checked.column("target").to_numpy(zero_copy_only=False).astype(float)) if len(features) else None

    def scored(self, name: str) -> DataFrame:
        weight = F.lit(0.0)
        if self.fitted is not None:
            weight = _evidence_of(self.weights, self.fitted)(F.col("text"))
        uniform = (F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        noise = -F.log(-F.log(uniform))
        weighed = self.docs.withColumn(name, weight)
        return weighed.withColumn(
            name, F.struct(F.col(name).alias("log_weight"), (F.col(name) * SHARPNESS + noise).alias("perturbed"))
        )

    def cut(self) -> float:
        """Perturbed weight of the k-th document, k the expected number of target documents."""
        if self.fitted is None:
            return float("-inf")
        s = stored(self.scored("_s").select("_s.*"), "scores")
        rows, expected = s.agg(F.count(F.lit(1)), F.sum(F.exp("log_weight"))).first()
        return kth_largest(s, "perturbed", min(rows, max(1, round(expected)))) if rows else float("-inf")


def importance_sample(docs: DataFrame, labels: DataFrame, name: str = "sampled") -> DataFrame:
    """All columns, and struct ``name``: log_weight, perturbed, kept."""
    if name in docs.columns:
        raise ValueError(f"{name} is a column of the documents")
    model = Resampler(docs, labels)
    cut = model.cut()
    return model.scored(name).withColumn(name, F.col(name).withField("kept", F.col(f"{name}.perturbed") >= cut))


def importance_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled documents, columns unchanged."""
    name = free_name(docs, "sampled")
    return importance_sample(docs, labels, name).filter(F.col(f"{name}.kept")).select(docs.columns)
