"""Near-duplicate documents by a chosen-path set similarity join on word shingles.

1. A document becomes the set of its distinct word shingles. Documents with equal sets form a
   class; all later work is on classes. A class has 128 minwise tokens, and a sketch of one byte of
   each.
2. Trees: a node branches its members by the values of a few of their minwise tokens; which tokens
   a node selects depends on the node alone, one and a further one as often as keeps the expected
   number of paths of two similar sets from shrinking (1 / similarity per level). A node is a leaf if
   it has at most ``LEAF`` members, if it is dense (it still has more than the share ``DENSE`` of its
   parent's members, so branching does not part them), or at ``DEPTH`` levels. ``TREES`` independent
   trees raise recall.
3. The members of a leaf are compared with each other by their sketches; large leaves in pairs of
   blocks. Pairs whose sketches agree as similar sets' do are candidates; a leaf reports a chain
   through each of its connected groups instead of all pairs. Connected candidates form clusters.
4. Links are confirmed on full sets: a cluster is compared exhaustively in blocks of bounded size;
   within a block the sizes of all intersections come from one matrix product. Blocks of a large
   cluster are then joined through one member of each of their linked groups, and what is still
   outside the cluster's largest group is compared with every block. So every pair of a cluster
   that does not already hang together is compared on full sets.
5. Linked classes are joined into components.

Shingles are compared as 64-bit hashes of their words.

Defined results:

* null text, or no words: the set is empty and links with nothing.
* very long texts: the set has the shingles of the whole text and is held by one task at a time.
* fewer words than a shingle has: the whole sequence is the only shingle.
* the representative of a component is its smallest id, the first of repeated rows; null ids come
  last, and a component of null ids only has a null id.
* an empty table gives an empty result. Other columns are kept by the stage and not read by the
  operator, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.common import free_name, stored, with_row_key
from sheetwise.llm.components import components
from sheetwise.llm.groups import chains, runs

TOKENS = 128
TREES = 10
DEPTH = 4
LEAF = 128
DENSE = 0.5
#: Members of a leaf that are compared at once, beyond which pairs of blocks are.
LEAF_BLOCK = 2048
#: Classes and shingles of a block that is compared on full sets.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1_000_000
#: Standard deviations below the expected agreement at which a pair is no candidate.
DEVIATIONS = 4.7
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hash of 64-bit integers."""
    x = np.asarray(x, np.uint64) + MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTORS = mix(np.arange(TOKENS)) | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    found = (text or "").encode().lower().split()  # ASCII letters and blanks only
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    if not width:
        return hashes
    rolled = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        rolled = mix(rolled * MIX + hashes[i : i + len(rolled)])
    return np.unique(rolled)


def minwise(shingles: np.ndarray) -> np.ndarray:
    tokens = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):  # stays in the processor's cache
        part = shingles[at : at + 4096]
        tokens = np.minimum(tokens, (FACTORS[:, None] * part[None, :]).min(1))
    return (mix(tokens) >> np.uint64(32)).astype(np.uint32)


def _signatures(words: int):
    kind = T.StructType(
        [
            T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
            T.StructField("tokens", T.BinaryType()), T.StructField("sketch", T.BinaryType()),
        ]
    )

    def sign(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            shingles = shingle_set(text.as_py(), words)
            if not len(shingles):
                rows.append((0, None, None, None))
                continue
            tokens = minwise(shingles)
            digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
            rows.append((len(shingles), digest, tokens.tobytes(), tokens.astype(np.uint8).tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=kind.names)

    return F.arrow_udf(sign, kind)


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def branches(nodes: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of the members of ``nodes``: (row, child), the same choice for equal nodes."""
    rows, more = np.arange(len(nodes)), mix(nodes + np.uint64(1))
    extra = np.flatnonzero(more.astype(float) / 2.0**64 < 1 / similarity - 1)
    first = (mix(nodes) % np.uint64(TOKENS)).astype(np.int64)
    second = (mix(nodes + np.uint64(2)) % np.uint64(TOKENS)).astype(np.int64)
    at = np.concatenate([rows, extra])
    chosen = np.concatenate([first, second[extra]])
    child = mix(mix(nodes[at] ^ (chosen.astype(np.uint64) << np.uint64(48))) + tokens[at, chosen])
    return at, child


def _children(similarity: float, roots: bool):
    def grow(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _matrix(batch.column("tokens"), np.uint32).astype(np.uint64)
            parents = batch.column("members")
            if roots:
                starts = [mix(np.full(len(tokens), t)) for t in range(TREES)]
            else:
                starts = [batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)]
            for nodes in starts:
                at, child = branches(nodes, tokens, similarity)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), batch.column("digest").take(at), parents.take(at)],
                    names=["node", "digest", "of"],
                )

    return grow


def least_agreement(similarity: float) -> int:
    """Equal bytes of two sketches below which the sets are not similar."""
    equal = similarity + (1 - similarity) / 256
    return int(TOKENS * equal - DEVIATIONS * (TOKENS * equal * (1 - equal)) ** 0.5)


def _compare_leaves(least: int):
    def compare(batches):
        for leaf in runs(batches, ["node", "low", "high"]):
            sketches = _matrix(leaf.column("sketch"), np.uint8)
            linked = np.zeros((len(sketches),) * 2, bool)
            for at in range(0, len(sketches), 32):
                part = sketches[at : at + 32]
                linked[at : at + 32] = (part[:, None, :] == sketches[None, :, :]).sum(2) >= least
            if pairs := chains(linked):
                digests = leaf.column("digest").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[i] for i, _ in pairs], pa.binary()),
                     pa.array([digests[j] for _, j in pairs], pa.binary())], names=["a", "b"],
                )

    return compare


def _leaves(classes: DataFrame, similarity: float) -> DataFrame:
    """``(node, members, digest)`` of all leaves with two members or more."""
    found, nodes = None, None
    total = classes.count()
    for depth in range(1, DEPTH + 1):
        source = classes.select("digest", "tokens", F.lit(total).cast("bigint").alias("members"))
        if nodes is not None:
            source = nodes.select("node", "digest", "members").join(source.drop("members"), "digest")
        grown = source.mapInArrow(_children(similarity, nodes is None), "node bigint, digest binary, of bigint")
        sizes = grown.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.max("of").alias("of")).filter("members > 1")
        sized = stored(grown.drop("of").join(sizes, "node"), f"nodes_{depth}")
        leaf = (F.col("members") <= LEAF) | (F.col("members") > DENSE * F.col("of")) | F.lit(depth == DEPTH)
        ends = sized.filter(leaf).drop("of")
        found = ends if found is None else found.unionByName(ends)
        nodes = sized.filter(~leaf)
        if nodes.isEmpty():
            break
    return found


def candidate_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that connect all classes which the trees bring together as similar."""
    blocks = F.ceil(F.col("members") / LEAF_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("digest", "node"), F.col("blocks")).cast("int")
    dealt = (
        _leaves(classes, similarity)
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "digest", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        .join(classes.select("digest", "sketch"), "digest")
    )
    keys = ["node", "low", "high"]
    together = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(_compare_leaves(least_agreement(similarity)), "a binary, b binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = often[code] > 1
    owner, code = owner[common], code[common]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], np.unique(code[order], return_inverse=True)[1]
    shared = np.zeros((len(sets),) * 2, np.float64)
    width = max(256, (1 << 22) // len(sets))
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        low, high = np.searchsorted(code, [first, first + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[low:high], code[low:high] - first] = 1
        shared += held @ held.T
    shared[np.diag_indices(len(sets))] = [len(s) for s in sets]
    return shared.astype(np.int64)


def _similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    sizes, shared = np.array([len(s) for s in sets]), shared_counts(sets)
    return 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)


def _confirm(percent: int):
    def confirm(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        pairs = chains(_similar(sets, percent)) if len(sets) > 1 else []
        digests = group.column("digest").to_pylist()
        ends = [[digests[i] for i, _ in pairs], [digests[j] for _, j in pairs]]
        return pa.table([pa.array(e, pa.binary()) for e in ends], names=["a", "b"])

    return confirm


def _sets(words: int):
    def make(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), words).tobytes() for t in texts], pa.binary())

    return F.arrow_udf(make, T.BinaryType())


def _exact(groups: DataFrame, keys: list[str], percent: int) -> DataFrame:
    return groups.groupBy(*keys).applyInArrow(_confirm(percent), "a binary, b binary")


def confirmed_links(members: DataFrame, percent: int) -> DataFrame:
    """Links on full sets among ``members(cluster, digest, n_shingles, shingles)`` of clusters."""
    sizes = members.groupBy("cluster").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
        ).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = stored(members.join(sizes, "cluster").withColumn("block", block), "blocks")
    links = stored(_exact(dealt, ["cluster", "block"], percent), "links_within")
    large = dealt.filter("blocks > 1")
    if large.isEmpty():
        return links
    # one member of each linked group of a block, compared with those of the other blocks
    groups = stored(_labelled(large.drop("shingles"), links), "block_groups")
    firsts = groups.groupBy("cluster", "block", "root").agg(F.min("digest").alias("digest")).drop("root")
    chosen = firsts.select("cluster", "digest").join(large.select("digest", "shingles", "n_shingles"), "digest")
    some = chosen.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts")
    )
    parted = chosen.join(some, "cluster").withColumn("part", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("parts")))
    links = links.unionByName(stored(_exact(parted, ["cluster", "part"], percent), "links_across"))
    # whoever is outside the largest group visits every block
    groups = stored(_labelled(large.drop("shingles"), links), "cluster_groups")
    counts = stored(groups.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")), "group_sizes")
    largest = counts.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("root"))
    outside = groups.join(largest, ["cluster", "root"], "left_anti")
    shares = outside.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("shares")
    )
    share = F.pmod(F.xxhash64("digest", F.lit(2)), F.col("shares")).cast("int")
    outside = stored(
        outside.join(shares, "cluster")
        .select("cluster", "digest", "blocks", share.alias("share"))
        .join(large.select("digest", "shingles"), "digest"),
        "visitors",
    )
    visits = outside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hosts = large.join(shares, "cluster").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    columns = ["cluster", "block", "share", "digest", "shingles"]
    met = visits.select(*columns).unionByName(hosts.select(*columns))
    return links.unionByName(stored(_exact(met, ["cluster", "block", "share"], percent), "links_outside"))


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).select(F.col("node").alias("digest"), "root")
    return members.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", row: str | None = None
) -> DataFrame:
    """Per row: ``row`` (its key, or the given one), doc_id, n_shingles, component_id, and whether it is kept.

    ``kept``: the id is the component's. ``first``: the one row that stands for the component.
    """
    named = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")]
    keyed = docs.select(F.col(row).alias("row"), *named) if row else with_row_key(docs.select(*named), "row")
    signed = stored(
        keyed.select("row", "doc_id", _signatures(words)("text").alias("s")).select("row", "doc_id", "s.*"), "signed"
    )
    rank = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), "row")
    classes = stored(
        signed.filter("n_shingles > 0").groupBy("digest").agg(
            F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"),
            F.first("n_shingles").alias("n_shingles"), F.min(rank).alias("best"),
        ), "classes",
    )
    clusters = components(candidate_links(classes, percent / 100))
    wanted = (
        clusters.select(F.col("node").alias("digest"), F.col("root").alias("cluster"))
        .join(classes.select("digest", "n_shingles", F.col("best.row").alias("row")), "digest")
    )
    members = stored(
        keyed.select("row", "text").join(wanted, "row")
        .select("cluster", "digest", "n_shingles", _sets(words)("text").alias("shingles")),
        "members",
    )
    roots = components(confirmed_links(members, percent)).withColumnRenamed("node", "digest")
    rooted = stored(classes.select("digest", "best").join(roots, "digest", "left"), "rooted")
    bests = rooted.filter("root is not null").groupBy("root").agg(F.min("best").alias("of_all"))
    linked = rooted.filter("root is not null").join(bests, "root").select("digest", F.col("of_all").alias("best"))
    named = linked.unionByName(rooted.filter("root is null").select("digest", "best"))
    alone = F.col("n_shingles") == 0
    return signed.join(named, "digest", "left").select(
        "row", "doc_id", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("best.id"))).alias("kept"),
        (alone | (F.col("row") == F.col("best.row"))).alias("first"),
    )


def near_dedup_stage(docs: DataFrame) -> DataFrame:
    """One document of each group stays, columns unchanged; five words, similarity 0.8."""
    key = free_name(docs, "row")
    keyed = with_row_key(docs, key)  # numbered once: rows after a shuffle may come in another order
    rows = near_duplicates(keyed, row=key).filter("first").select(F.col("row").alias(key))
    return keyed.join(rows, key, "left_semi").select(docs.columns)
