"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Equal vectors of a label form a class; all later work is on classes.
2. Codes: vectors of length one are centred, turned by their principal axes, and then by a rotation
   that brings them closest to the corners of the cube (iterative quantisation: assign corners,
   solve for the rotation, repeat). The signs are the code. Several rotations from different starts
   give further codes. They are fitted on at most ``SAMPLE_VALUES`` numbers; every class is coded.
3. Tables: a code is cut into chunks; a class enters one table per chunk, under its label, length
   and chunk. Chunks get longer with the number of classes, so buckets stay small. Sampled vectors
   get partners at exactly the threshold; codes are added until the wanted share of these pairs
   meets in some table, also among the tenth whose angle centring widens most. Where that would
   take more than ``MOST_TABLES``, chunks are shorter instead: buckets grow, and no pair is lost.
   A bucket with more than ``BLOCK`` classes is compared in pairs of blocks.
4. Members of a bucket with some other code within the Hamming distance that the made pairs have
   are compared by cosine in double precision. A pair counts in the first table in which it
   meets. Buckets report, per member, how many vectors it links with, and chains through linked
   members; no list of pairs is made.

Defined results:

* null label, null, empty or zero vector, null or non-finite component: no links, own component.
* vectors of different length are not compared.
* equal vectors are linked. Repeated rows count as vectors of their own.
* a null id is never the smallest of a component unless it is alone; then it is null.
* an empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import copy
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.common import stored
from sheetwise.llm.components import components
from sheetwise.llm.groups import chains, runs

SAMPLE_VALUES = 2_000_000
BITS, ITERATIONS = 64, 50
#: Wanted share of the pairs at the threshold that meet in some table.
RECALL = 0.985
#: Pairs at the threshold made for measuring it, and the number of tables that a plan may take.
MADE, MOST_TABLES = 4000, 64
#: Classes that should share a bucket, and that are compared at once.
BUCKET, BLOCK = 32, 1024


def valid_vector(row) -> np.ndarray | None:
    values = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0)
    vector = np.asarray(values, np.float64)
    return vector if len(vector) and np.isfinite(vector).all() and vector.any() else None


def _digests():
    def digest(vectors: pa.Array) -> pa.Array:
        found = []
        for row in vectors:
            vector = valid_vector(row)
            found.append(None if vector is None else hashlib.blake2b((vector + 0.0).tobytes(), digest_size=16).digest())
        return pa.array(found, pa.binary())

    return F.arrow_udf(digest, T.BinaryType())


def unit_rows(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors scaled to length one, padded with zeros to ``width``."""
    rows = np.zeros((len(vectors), width))
    for i, row in enumerate(vectors):
        vector = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
        vector = vector / np.abs(vector).max()  # squares stay finite
        rows[i, : len(vector)] = vector / np.linalg.norm(vector)
    return rows


class Quantiser:
    """Projections onto balanced binary codes."""

    def __init__(self, sample: np.ndarray):
        self.mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        self.axes = axes[:, ::-1][:, : min(BITS, sample.shape[1])]
        self.points, self.random = centred @ self.axes, np.random.default_rng(7)
        self.projections = []
        self.add()

    def add(self) -> None:
        """One more code, from another start."""
        turn, _ = np.linalg.qr(self.random.standard_normal((self.axes.shape[1],) * 2))
        for _ in range(ITERATIONS if len(self.points) else 0):
            corners = np.where(self.points @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(corners.T @ self.points)
            turn = (left @ right).T
        self.projections.append(self.axes @ turn)

    def fitted(self) -> Quantiser:
        """Without the sample, for the executors."""
        bare = copy.copy(self)
        bare.points = bare.random = None
        return bare

    def bits(self, units: np.ndarray) -> np.ndarray:
        """All codes side by side, one column per bit."""
        centred = units - self.mean
        return np.concatenate([centred @ p >= 0 for p in self.projections], axis=1)


def threshold_pairs(sample: np.ndarray, lengths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Sampled vectors and, for each, one at exactly the threshold.

    Half of the partners lie in any direction, half in the direction of another sampled vector.
    """
    random = np.random.default_rng(11)
    if not len(sample):
        return sample, sample
    chosen = random.integers(len(sample), size=MADE)
    units = sample[chosen]
    away = random.standard_normal(units.shape)
    away[::2] = sample[random.integers(len(sample), size=len(away[::2]))] - units[::2]
    away *= np.arange(sample.shape[1]) < lengths[chosen, None]
    away -= (away * units).sum(1, keepdims=True) * units
    size = np.linalg.norm(away, axis=1, keepdims=True)
    some = size[:, 0] > 1e-6
    units, away = units[some], away[some] / size[some]
    return units, threshold * units + math.sqrt(max(0.0, 1 - threshold * threshold)) * away


def table_plan(classes: int, bits: int, quantiser: Quantiser, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Bits of a chunk, and the bits that a similar pair has apart; codes are added to ``quantiser``."""
    chunk = min(bits, max(4, math.ceil(math.log2(max(classes, 1) / BUCKET + 1))))
    if not len(pairs[0]):
        return chunk, bits
    a, b = pairs[0] - quantiser.mean, pairs[1] - quantiser.mean
    cosine = (a * b).sum(1) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-300)
    widest = np.argsort(cosine)[: math.ceil(len(cosine) / 10)]
    while True:
        codes = [quantiser.bits(side) for side in pairs]
        equal = np.equal(*[_chunks(c, bits, chunk) for c in codes])
        met = equal.any(1)
        if min(met.mean(), met[widest].mean()) >= RECALL:
            break
        share = equal[widest].mean()
        wanted = math.log(1 - RECALL) / math.log(1 - share) if 0 < share < 1 else math.inf
        if max(wanted, equal.shape[1] + 1) > MOST_TABLES:
            chunk -= 1
        else:
            quantiser.add()
    apart = (codes[0] != codes[1]).sum(1)
    return chunk, math.ceil(max(apart.max(), apart.mean() + 4 * apart.std(), apart[widest].mean() + 4 * apart[widest].std()))


def _chunks(bits: np.ndarray, per_code: int, chunk: int) -> np.ndarray:
    """Value of each table's chunk, one column per table; without bits, one table that all share."""
    if not chunk:
        return np.zeros((len(bits), 1), np.int64)
    weights = (1 << np.arange(chunk, dtype=np.int64))[:, None]
    found = []
    for first in range(0, bits.shape[1], per_code):
        for at in range(first, first + per_code - chunk + 1, chunk):
            found.append(bits[:, at : at + chunk].astype(np.int64) @ weights)
    return np.concatenate(found, axis=1)


def _coder(quantiser: Quantiser, per_code: int, chunk: int, width: int):
    kind = T.StructType([T.StructField("bits", T.BinaryType()), T.StructField("chunks", T.ArrayType(T.LongType()))])

    def code(vectors: pa.Array) -> pa.Array:
        bits = quantiser.bits(unit_rows(vectors, width))
        chunks = _chunks(bits, per_code, chunk)
        packed = pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())
        offsets = pa.array(np.arange(len(chunks) + 1) * chunks.shape[1], pa.int32())
        return pa.StructArray.from_arrays(
            [packed, pa.ListArray.from_arrays(offsets, pa.array(chunks.ravel(), pa.int64()))], names=kind.names
        )

    return F.arrow_udf(code, kind)


KEYS = ["label", "length", "at", "value", "low", "high"]


def _promising(cut: int):
    """Members with another code within ``cut`` bits, in each bucket."""

    def find(batches):
        for bucket in runs(batches, KEYS):
            if bucket.num_rows < 2:
                continue
            rows = [np.frombuffer(b, np.uint8) for b in bucket.column("bits").to_pylist()]
            codes = np.unpackbits(np.stack(rows), axis=1).astype(np.float32)
            ones = codes.sum(1)
            near = ones[:, None] + ones[None, :] - 2 * (codes @ codes.T) <= cut
            near[np.diag_indices(len(rows))] = False
            kept = bucket.filter(pa.array(near.any(1))).drop_columns(["bits"])
            yield from kept.to_batches()

    return find


def _linked(threshold: float):
    """Per bucket, links counted in the first table in which a pair meets, and chains."""

    def link(batches):
        for bucket in runs(batches, KEYS):
            lengths = bucket.column("length")[0].as_py()
            units = unit_rows(bucket.column("embedding"), lengths)
            chunks = np.array(bucket.column("chunks").to_pylist())
            own = np.array(bucket.column("own").to_pylist())
            linked = units @ units.T >= threshold
            linked[np.diag_indices(len(units))] = False
            at = bucket.column("at")[0].as_py()
            for earlier in range(at):
                linked &= chunks[:, None, earlier] != chunks[None, :, earlier]
            if bucket.column("low")[0].as_py() != bucket.column("high")[0].as_py():
                linked &= own[:, None] != own[None, :]  # pairs within a block are compared there
            digests = bucket.column("class").to_pylist()
            vectors = np.array(bucket.column("vectors").to_pylist(), np.int64)
            counts = linked @ vectors
            rows = [{"a": digests[i], "b": None, "n": int(counts[i])} for i in np.flatnonzero(counts)]
            rows += [{"a": digests[i], "b": digests[j], "n": None} for i, j in chains(linked)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())]))

    return link


def _sample(classes: DataFrame, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of at most about ``SAMPLE_VALUES`` numbers, for the fit alone, and their lengths."""
    share = min(1.0, SAMPLE_VALUES / max(1, width * total))
    found = classes.sample(share, seed=3).select("embedding", "length").toArrow()
    return unit_rows(found.column(0), width), found.column(1).to_numpy()


def similar_vectors(
    vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``."""
    rows = stored(
        vectors.select(
            F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"),
            F.when(F.col(label).isNotNull(), _digests()(embedding)).alias("digest"),
        ), "vectors",
    )
    name = F.unhex(F.md5(F.concat("digest", F.col("label").cast("string").cast("binary"))))
    keyed = rows.withColumn("class", F.when(F.col("digest").isNotNull(), name))
    classes = stored(
        keyed.filter(F.col("class").isNotNull()).groupBy("class").agg(
            F.first("label").alias("label"), F.first("embedding").alias("embedding"),
            F.count(F.lit(1)).alias("vectors"), F.min("vec_id").alias("least"),
        ).withColumn("length", F.size("embedding")), "classes",
    )
    total, width = classes.agg(F.count(F.lit(1)), F.coalesce(F.max("length"), F.lit(1))).first()
    bits = min(BITS, width)
    sample, lengths = _sample(classes, total, width)
    quantiser = Quantiser(sample)
    chunk, most_apart = table_plan(total, bits, quantiser, threshold_pairs(sample, lengths, threshold))
    coded = stored(classes.withColumn("code", _coder(quantiser.fitted(), bits, chunk, width)("embedding")), "coded")
    tables = coded.select(
        "class", "label", "length", F.col("code.bits").alias("bits"), F.posexplode("code.chunks").alias("at", "value")
    )
    sizes = tables.groupBy("label", "length", "at", "value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    own = F.pmod(F.xxhash64("class", "at"), F.col("blocks")).cast("int")
    dealt = (
        tables.join(sizes, ["label", "length", "at", "value"])
        .withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "class", "label", "length", "at", "value", "own", "bits",
            F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        )
    )
    near = stored(
        dealt.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(
            _promising(most_apart), dealt.drop("bits").schema
        ), "near",
    )
    full = near.join(coded.select("class", "embedding", "vectors", F.col("code.chunks").alias("chunks")), "class")
    found = stored(
        full.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_linked(threshold), "a binary, b binary, n bigint"),
        "found",
    )
    counts = found.filter("n is not null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "class")
    rooted = stored(
        classes.select("class", "vectors", "least").join(roots, "class", "left").join(counts, "class", "left"), "rooted"
    )
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("least").alias("of_all"))
    linked = rooted.filter("root is not null").join(least, "root").withColumn("least", F.col("of_all")).drop("of_all")
    named = linked.unionByName(rooted.filter("root is null"), allowMissingColumns=True).select(
        "class", (F.coalesce("n", F.lit(0)) + F.col("vectors") - 1).alias("n"), "least"
    )
    result = keyed.select("vec_id", "class").join(named, "class", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"),
    )
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
