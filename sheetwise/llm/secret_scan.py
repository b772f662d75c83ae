"""Secrets in texts, by built-in SQL functions alone.

Three fixed rules find assigned values, access keys and long hexadecimal runs. Beyond them, runs of
characters that keys are written in are scored by two character Markov models, one of random
strings and one of ordinary identifiers: the sum of log-likelihood ratios of all transitions. A run
is a secret if that makes it more likely random than not, when one run in ``1 / PRIOR`` is. Runs
that spans of the fixed rules cover are left to those.

The models are trained on labelled samples: values that the fixed rules find are random; other runs
are ordinary, and so are names made of neighbouring words (snake, kebab, path and camel case), dates
and rulers. They come from about ``TRAIN_DOCS`` documents; the transition counts, the only thing
collected, are bounded by the alphabet. Unseen transitions weigh for the random model, whose prior
is flatter.

Where a pattern matches, the text is cut into matches and the pieces between them, and positions are
sums of lengths in code points; running sums are taken in chunks, so cost grows with the number of
matches and not with its square. Rows never leave their partition.

Defined results:

* null and empty text: no spans; counts are 0, the joined spans are empty.
* matches of a kind do not overlap; spans of different kinds may.
* repeated rows give the same result each. An empty table gives an empty result.
* other columns are kept as they are; the result is one struct column that the caller names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import free_name

#: The rules, the group whose length counts, and the least length.
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: For the two plain rules, the same matches with the least length in the pattern, which is faster.
FAST = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN, SAMPLE_RUN = r"[A-Za-z0-9+/_=-]{16,}", r"[A-Za-z0-9+/_=-]{8,}"
KINDS = [*RULES, "markov"]
TRAIN_DOCS = 5000
PRIOR = 1e-8
#: Pseudo-counts of each transition in the model of random and of ordinary strings.
FLAT = {True: 1.0, False: 0.1}
CHUNK = 512
SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(lengths: Column) -> Column:
    """Sums of the first 0, 1, ... values."""

    def sums(values: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(values) / CHUNK).cast("int")),
            lambda c: F.aggregate(F.slice(values, c * CHUNK + 1, CHUNK), F.lit(0).cast("bigint"), lambda s, x: s + x),
        )

        def within(by_chunk: Column) -> Column:
            before = F.transform(
                F.sequence(F.lit(0), F.size(by_chunk) - 1),
                lambda c: F.aggregate(F.slice(by_chunk, 1, c), F.lit(0).cast("bigint"), lambda s, x: s + x),
            )
            return let(
                before,
                lambda b: F.transform(
                    F.sequence(F.lit(0), F.size(values)),
                    lambda i: F.get(b, F.floor(i / CHUNK).cast("int"))
                    + F.aggregate(
                        F.slice(values, F.floor(i / CHUNK).cast("int") * CHUNK + 1, F.pmod(i, F.lit(CHUNK))),
                        F.lit(0).cast("bigint"),
                        lambda s, x: s + x,
                    ),
                ),
            )

        return let(chunks, within)

    return let(F.transform(lengths, lambda x: x.cast("bigint")), sums)


def _spans(text: Column, kind: str, pattern: str, keep) -> Column:
    """Spans of all matches for which ``keep(match number, match)`` holds."""

    def of(parts: Column) -> Column:
        steps = F.transform(
            parts["found"], lambda m, i: F.length(F.get(parts["between"], i)) + F.length(m)
        )
        return let(
            running_sums(steps),
            lambda sums: F.filter(
                F.transform(
                    parts["found"],
                    lambda m, i: F.when(
                        keep(parts, m, i),
                        F.struct(
                            (F.get(sums, i + 1) - F.length(m)).alias("start"),
                            F.lit(KINDS.index(kind)).alias("rank"),
                            F.lit(kind).alias("kind"),
                            F.get(sums, i + 1).alias("stop"),
                        ),
                    ),
                ),
                lambda s: s.isNotNull(),
            ),
        )

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("between"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else F.array().cast("array<string>")).alias("value"),
    )
    return let(parts, of)


def base_spans(text: Column) -> Column:
    """Spans of the fixed rules, sorted by start and kind."""
    found = []
    for kind, (pattern, group, least) in RULES.items():
        fast = FAST.get(kind, pattern)

        def keep(parts, match, i, group=group, least=least):
            return F.length(F.get(parts["value"], i) if group else match) >= least

        found.append(F.when(text.rlike(fast), _spans(text, kind, fast, keep)).otherwise(F.array().cast(SPAN)).cast(SPAN))
    return F.array_sort(F.concat(*found))


def codes(run: Column) -> Column:
    """Place of each character in the alphabet, from 1."""
    return F.transform(F.split(run, "(?!^)", -1), lambda c: F.position(c, F.lit(ALPHABET)))


def transitions(run: Column) -> Column:
    """A number for each pair of neighbouring characters."""
    return let(
        codes(run),
        lambda c: F.zip_with(
            F.slice(c, 1, F.size(c) - 1),
            F.slice(c, 2, F.size(c) - 1),
            lambda a, b: (a - 1) * len(ALPHABET) + b - 1,
        ),
    )


def labelled_samples(docs: DataFrame, text: str, documents: int = TRAIN_DOCS) -> DataFrame:
    """``(run, random)`` from a share of the documents of bounded expected size."""
    share = min(1.0, documents / max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(text).alias("text"))
    values, rest = [], F.col("text")
    for kind, (pattern, group, least) in RULES.items():
        fast = FAST.get(kind, pattern)
        values.append(F.filter(F.regexp_extract_all("text", F.lit(fast), F.lit(group)), _at_least(least)))
        rest = F.regexp_replace(rest, fast, " ")
    ordinary = F.concat(F.regexp_extract_all(rest, F.lit(SAMPLE_RUN), F.lit(0)), _names(rest))
    runs = F.concat(
        F.transform(F.concat(*values), lambda v: F.struct(v.alias("run"), F.lit(True).alias("random"))),
        F.transform(ordinary, lambda v: F.struct(v.alias("run"), F.lit(False).alias("random"))),
    )
    plain = docs.sparkSession.sql("""
        SELECT explode(concat(
            transform(sequence(date'1990-01-01', date'2039-12-31', interval 1 month), d -> date_format(d, 'yyyy-MM-dd')),
            transform(split('-=_+/', '(?!^)'), c -> repeat(c, 20000)))) AS run, false AS random""")
    return chosen.select(F.explode(runs).alias("s")).select("s.*").unionByName(plain)


def _names(text: Column) -> Column:
    """Names as programs and paths have them, of three neighbouring words each."""

    def made(words: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(12)),
                lambda i: F.array(
                    F.array_join(F.slice(words, i, 3), "_"),
                    F.array_join(F.slice(words, i + 3, 3), "-"),
                    F.array_join(F.slice(words, i + 6, 3), "/"),
                    F.array_join(F.transform(F.slice(words, i + 9, 3), F.initcap), ""),
                ),
            )
        )

    return let(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0)), made)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition, random against ordinary."""
    size = len(ALPHABET)
    usable = F.regexp_replace("run", r"[^A-Za-z0-9+/_=-]", "")  # the point of assigned values is left out
    counted = (
        samples.select("random", usable.alias("run"))
        .filter(F.length("run") > 1)
        .select("random", F.explode(transitions(F.col("run"))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()  # at most two counts for each pair of characters
    )
    counts = {kind: [0.0] * size * size for kind in FLAT}
    for row in counted:
        counts[row["random"]][row["pair"]] = row["count"]
    logs = {}
    for kind, flat in FLAT.items():
        values = []
        for a in range(size):
            row = counts[kind][a * size : (a + 1) * size]
            total = sum(row) + flat * size
            values += [math.log((n + flat) / total) for n in row]
        logs[kind] = values
    return [r - o for r, o in zip(logs[True], logs[False], strict=True)]


def random_score(run: Column, weights: list[float]) -> Column:
    table = F.from_json(F.lit(json.dumps([round(w, 4) for w in weights])), "array<double>")
    return F.aggregate(transitions(run), F.lit(0.0), lambda s, t: s + F.get(table, t))


def _markov_spans(text: Column, base: Column, weights: list[float]) -> Column:
    least = math.log((1 - PRIOR) / PRIOR)

    def random(run: Column) -> Column:
        return random_score(run, weights) >= least

    found = _spans(text, "markov", RUN, lambda parts, match, i: random(match)).cast(SPAN)
    some = F.exists(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), random)

    def covered(m: Column) -> Column:
        # base spans are sorted; how far they cover the run without a gap
        reach = F.aggregate(
            base,
            m["start"],
            lambda at, b: F.when((b["start"] <= at) & (b["stop"] > at), b["stop"]).otherwise(at),
        )
        return reach >= m["stop"]

    apart = F.filter(found, lambda m: ~covered(m))
    return F.when(some, apart).otherwise(F.array().cast(SPAN))


def secret_spans(docs: DataFrame, text: str = "text", found: str = "secrets", weights: list[float] | None = None) -> DataFrame:
    """All columns, and struct ``found`` with ``base`` and ``spans``: sorted arrays of spans."""
    if found in docs.columns:
        raise ValueError(f"{found} is a column of the documents")
    if weights is None:
        weights = train(labelled_samples(docs, text))
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = let(
        base_spans(whole),
        lambda base: F.struct(
            base.alias("base"), F.array_sort(F.concat(base, _markov_spans(whole, base, weights))).alias("spans")
        ),
    )
    return docs.withColumn(found, spans)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def _at_least(length: int):
    return lambda value: F.length(value) >= length


def secret_report(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: list[float] | None = None
) -> DataFrame:
    """Per document: numbers of base spans, their digest, and all spans."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = secret_spans(texts, found="secrets", weights=weights)

    def report(s: Column) -> Column:
        counts = [
            F.size(F.filter(s["base"], _is_kind(kind))).cast("bigint").alias(f"n_{kind}") for kind in RULES
        ]
        return F.struct(
            *counts, F.sha2(joined(s["base"]).cast("binary"), 256).alias("base_sha256"), joined(s["spans"]).alias("spans")
        )

    return found.select("doc_id", let(F.col("secrets"), report).alias("r")).select("doc_id", "r.*")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark in place of each run of touching spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, span: Column) -> Column:
        apart = F.concat(
            done["parts"],
            F.array(F.substring(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")), F.lit(mark)),
        )
        return F.struct(
            F.greatest(done["at"], span["stop"]).alias("at"),
            F.when((span["start"] >= done["at"]) & ((span["start"] > 0) | (done["at"] == 0)), apart).otherwise(done["parts"]).alias("parts"),
        )

    return F.aggregate(
        spans,
        start,
        step,
        lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )


def secret_stage(docs: DataFrame, mark: str = "[secret]", weights: list[float] | None = None) -> DataFrame:
    """Documents with all secrets replaced by a mark, ``n_chars`` of those counted anew."""
    name, new = free_name(docs, "secrets"), free_name(docs, "redacted")
    spans = F.col(f"{name}.spans")
    marked = secret_spans(docs, found=name, weights=weights).withColumn(new, F.when(F.size(spans) > 0, redacted(F.col("text"), spans, mark)))
    length = F.coalesce(F.length(new), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    values = {"text": F.coalesce(new, "text"), "n_chars": length}
    return marked.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns])
