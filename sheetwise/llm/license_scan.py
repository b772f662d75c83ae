"""Licence notices in texts: a trained paragraph classifier, confirmed by template comparison.

Each text is split once; its words, and pairs of neighbours, become numbers, and windows are slices of
these. Lines are read in overlapping windows of words, so a notice inside a long line is seen whole. For a
notice wrapped over lines, the ``AROUND`` words on both sides of every line break are a
window too, up to the next line without a word: the longest template fits in whichever way it is
broken. Windows become sparse vectors of hashed words and word pairs, and a multinomial
logistic regression names the licence family or ``unknown``. It is trained on the templates below,
whole, cut short, in twos and set into lines of the corpus, against plain lines of about ``TRAIN_DOCS``
documents. A temperature, chosen on held-out samples, and the share of windows with a notice
calibrate the probabilities. Every family of at least ``LEAST`` is a prediction, so two licences of
one window are both named. A prediction is confirmed if the window has most of the words and word
pairs of a template of that family, and, beside a more probable family, one that family lacks.

All of it is DataFrame functions and Spark's own feature and regression classes; rows are scored
where they lie, without a shuffle.

Defined results:

* null and empty texts, and texts without a word, have no paragraphs and give no row.
* each window and family with a notice is a row, so a notice where two windows overlap gives two.
  ``paragraph`` is the number of the line, for a window over a break that of the line before it.
* a window over a break gives no row for a family that a line of it confirms: that line has the row.
* repeated rows give the same rows each. An empty table gives an empty result.
* other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.common import stored
from sheetwise.llm.secret_scan import let

#: Notices of each family, as their licences ask them to be worded.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License You may obtain a copy of the License",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "Licensed under the GNU General Public License, version 2",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3"],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, Version 2.0",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal",
        "This is free and unencumbered software released into the public domain",
    ],
}
FAMILIES = ["unknown", *sorted(TEMPLATES)]
TRAIN_DOCS = 3000
WINDOW, STEP = 40, 24
#: Words on each side of a line break; the longest template has 29 words.
AROUND = 34
FEATURES_LOG = 16
LEAST, OVERLAP = 0.1, 0.75
#: Share of windows that bear a notice.
NOTICES = 0.05
#: Windows of the corpus with less of every template are samples of the unknown class.
UNLIKE = 0.5
#: Tasks that the samples, bounded by ``TRAIN_DOCS``, are fitted in.
FIT_TASKS = 1
TEMPERATURES = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]


def number(word: Column) -> Column:
    return F.xxhash64(word)


def numbers(text: Column) -> Column:
    """All words of a text and, as words of their own, its line breaks, numbered. One split per text."""
    marked = F.split(F.lower(F.replace(text, F.lit("\n"), F.lit(" \n "))), "[^\\p{L}\\p{N}\n]+", -1)
    return F.transform(F.filter(marked, lambda w: w != ""), number)


def pairs(tokens: Column) -> Column:
    """A number for each two neighbouring words."""
    last = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, last), F.slice(tokens, 2, last), lambda a, b: F.xxhash64(a, b))


def grams(tokens: Column) -> Column:
    """Words and pairs of neighbouring words."""
    return let(tokens, lambda t: F.concat(t, pairs(t)))


def _views(words: Column, of_pairs: Column, ends: Column, blanks: Column) -> Column:
    """All windows of a text: its words, pairs of neighbours, the words before the end of each line, and
    whether some line has no word."""

    def view(line: Column, first_word: Column, low: Column, high: Column, near: Column) -> Column:
        return F.struct(
            line.alias("paragraph"),
            first_word.alias("first_word"),
            F.slice(words, low + 1, high - low).alias("tokens"),
            F.slice(of_pairs, low + 1, F.greatest(high - low - 1, F.lit(0))).alias("pairs"),
            low.alias("low"),
            near.alias("near"),
        )

    def start(i: Column) -> Column:
        return F.coalesce(F.get(ends, i - 1), F.lit(0))

    def of_line(end: Column, i: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest(end - start(i) - (WINDOW - STEP) - 1, F.lit(0)), F.lit(STEP))
        cut = F.transform(firsts, lambda f: view(i, f, start(i) + f, F.least(end, start(i) + f + WINDOW), F.array().cast("array<int>")))
        return F.when(end > start(i), cut)

    def of_break(end: Column, i: Column) -> Column:
        def around(near: Column) -> Column:
            # a line without a word ends where the line before it does
            blank = F.filter(near, lambda x, k: x == F.get(near, k + 1))
            before = F.when(blanks, F.array_max(F.filter(blank, lambda x: x < end)))
            behind = F.when(blanks, F.array_min(F.filter(blank, lambda x: x > end)))
            low = F.greatest(F.coalesce(before, F.lit(0)), end - AROUND)
            high = F.least(F.coalesce(behind, F.size(words)), end + AROUND)
            return view(i, F.greatest(low - start(i), F.lit(0)), low, high, near)

        first = F.greatest(i - AROUND, F.lit(0))
        return F.when((end > start(i)) & (F.get(ends, i + 1) > end), let(F.slice(ends, first + 1, i - first + AROUND + 1), around))

    found = [F.filter(F.transform(ends, of), lambda v: v.isNotNull()) for of in (of_line, of_break)]
    return F.concat(F.flatten(found[0]), found[1])


def windows(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, first_word, tokens, pairs, low, near`` of the texts in ``docs(doc_id, text)``.

    Windows of lines, whose ``near`` is empty, and windows around line breaks, with the words of the
    text before them and before the breaks near them.
    """

    line_break = number(F.lit("\n"))

    def of_text(n: Column) -> Column:
        words = F.filter(n, lambda x: x != line_break)
        breaks = F.filter(F.transform(n, lambda x, i: F.when(x == line_break, i)), lambda i: i.isNotNull())
        before = let(breaks, lambda b: F.transform(b, lambda at, i: at - i))

        def of_ends(w: Column, e: Column) -> Column:
            blank = F.size(F.filter(e, lambda x, k: x == F.get(e, k - 1))) > 0
            return let(pairs(w), lambda p: let(blank, lambda b: _views(w, p, e, b)))

        return let(words, lambda w: let(F.concat(before, F.array(F.size(w))), lambda e: of_ends(w, e)))

    return docs.select("doc_id", F.explode(let(numbers(F.col("text")), of_text)).alias("v")).select("doc_id", "v.*")


def lines(tokens: Column, low: Column, near: Column) -> Column:
    """Words and pairs of each line of a window around a break, null for other windows."""

    def of(bounds: Column) -> Column:
        return F.transform(
            F.slice(bounds, 2, F.size(bounds)),
            lambda end, k: grams(F.slice(tokens, F.get(bounds, k) + 1, end - F.get(bounds, k))),
        )

    inside = F.filter(near, lambda x: (x > low) & (x < low + F.size(tokens)))
    breaks = F.transform(inside, lambda x: x - low)
    return F.when(F.size(near) > 0, let(F.concat(F.array(F.lit(0)), breaks, F.array(F.size(tokens))), of))


def _notices() -> Column:
    """All templates as an array of (family number, tokens)."""
    rows = [(FAMILIES.index(f), t) for f, ts in sorted(TEMPLATES.items()) for t in ts]
    return F.expr(f"array({', '.join(f"named_struct('label', {i}, 'notice', {_constant(_hashed()[t][0])})" for i, t in rows)})")


def template_words(template: str) -> list[str]:
    """The words of a template; a literal, so that it is not split again for every row."""
    return re.findall("[a-z0-9]+", template.lower())


@functools.cache
def _hashed() -> dict[str, tuple[list[int], list[int]]]:
    """The numbers of each template's words, and its ``grams``. Hashed once, so that plans have constants."""
    templates = [t for ts in TEMPLATES.values() for t in ts]
    words = [F.transform(F.split(F.lit(" ".join(template_words(t))), " "), number) for t in templates]
    row = SparkSession.active().range(1).select(*[let(w, lambda t: F.struct(t, grams(t))) for w in words]).first()
    return {t: tuple(found) for t, found in zip(templates, row, strict=True)}


def _constant(values: Iterable[int]) -> str:
    """SQL of an array of numbers."""
    return f"array({', '.join(f'{n}L' for n in values)})"


def training_samples(docs: DataFrame, documents: int = TRAIN_DOCS) -> DataFrame:
    """``label, tokens, held``: lines of the corpus as unknown, and the templates among such lines."""
    share = min(1.0, documents / max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    likeness = let(F.concat("tokens", "pairs"), lambda g: F.greatest(*[_overlap(g, t) for ts in TEMPLATES.values() for t in ts]))
    # both kinds of windows are cut once; a line of a wrapped notice is unlike every template, but no
    # sample of the unknown class
    cut = stored(windows(chosen).withColumn("likeness", likeness).select("doc_id", "tokens", "likeness", (F.size("near") > 0).alias("wrapped")), "license_windows")
    noticed = cut.filter((F.col("likeness") >= UNLIKE) & F.col("wrapped")).select(F.col("doc_id").alias("of")).distinct()
    plain = cut.filter(F.col("likeness") < UNLIKE).join(noticed, F.col("doc_id").eqNullSafe(F.col("of")), "left_anti").select("tokens")
    some = plain.distinct().withColumn("h", F.xxhash64("tokens")).orderBy("h").limit(3 * documents)
    templates, many = _notices(), F.lit(sum(map(len, TEMPLATES.values())))
    at = F.pmod("h", many).cast("int")
    noticed = some.withColumn("n", F.get(templates, at)).withColumn("form", F.pmod(F.shiftright("h", 8), F.lit(8)))
    size = F.size("n.notice")
    room = F.greatest(F.greatest(F.lit(WINDOW), F.size("tokens")) - size, F.lit(0))
    before = F.pmod(F.shiftright("h", 24), room + 1).cast("int")
    headless, tailless = F.slice("n.notice", 2, size), F.slice("n.notice", 1, F.greatest(size - 2, F.lit(3)))
    # whole, without the first or last words, alone or cut by the edge of the window, behind other
    # words, before them, among them
    forms = [
        F.col("n.notice"),
        headless,
        tailless,
        F.concat(headless, F.slice("tokens", 1, room)),
        F.concat(F.slice("tokens", 1, room), tailless),
        F.concat(F.slice("tokens", 1, room), "n.notice"),
        F.concat(F.col("n.notice"), F.slice("tokens", 1, room)),
        F.concat(F.slice("tokens", 1, before), F.col("n.notice"), F.slice("tokens", before + 1, room - before)),
    ]
    chosen_form = reduce(lambda rest, i: F.when(F.col("form") == i, forms[i]).otherwise(rest), range(1, len(forms)), forms[0])
    held = (F.pmod(F.shiftright("h", 16), F.lit(4)) == 0).alias("held")
    known = noticed.select(F.col("n.label").cast("double").alias("label"), chosen_form.alias("tokens"), held)
    # two families in one window, once under each
    other = F.get(templates, F.pmod(F.xxhash64("h"), many).cast("int"))
    twos = noticed.filter(F.pmod(F.shiftright("h", 12), F.lit(4)) == 0).withColumn("o", other).filter("n.label <> o.label")
    both = F.concat("n.notice", F.slice("tokens", 1, F.pmod(F.shiftright("h", 32), F.lit(8)).cast("int")), "o.notice")
    for label in ("n.label", "o.label"):
        known = known.unionByName(twos.select(F.col(label).cast("double").alias("label"), both.alias("tokens"), held))
    return known.unionByName(some.select(F.lit(0.0).alias("label"), "tokens", held)).unionByName(
        known.sparkSession.range(1).select(F.explode(templates).alias("n")).select(
            F.col("n.label").cast("double").alias("label"), F.col("n.notice").alias("tokens"), F.lit(False).alias("held")
        )
    )


class LicenseModel:
    def __init__(self, regression: LogisticRegressionModel, temperature: float):
        self.regression, self.temperature = regression, temperature

    def probabilities(self, frame: DataFrame) -> DataFrame:
        """Adds array column ``p``, a calibrated probability per family."""
        raw = self.regression.transform(_vectors(frame))
        # half of the training samples bear a notice, so the odds of the unknown class are put right
        odds = F.lit(math.log((1 - NOTICES) / NOTICES))
        scaled = F.transform(
            vector_to_array("rawPrediction"), lambda x, i: x / self.temperature + F.when(i == 0, odds).otherwise(0.0)
        )
        exp = let(scaled, lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))))
        p = let(exp, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))
        return raw.withColumn("p", p).drop("grams", "features", "rawPrediction", "probability", "prediction")


def _vectors(frame: DataFrame) -> DataFrame:
    hashing = HashingTF(numFeatures=1 << FEATURES_LOG, binary=True, inputCol="grams", outputCol="features")
    return hashing.transform(frame.withColumn("grams", F.concat("tokens", "pairs") if "pairs" in frame.columns else grams(F.col("tokens"))))


def train(docs: DataFrame) -> LicenseModel:
    """Fit on three quarters of the samples, calibrate on the rest."""
    samples = stored(training_samples(docs), "license_samples")
    fit = _vectors(samples.filter("not held")).select("label", "features").coalesce(FIT_TASKS)
    regression = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60).fit(fit)
    held = regression.transform(_vectors(samples.filter("held"))).select(
        F.col("label").cast("int").alias("label"), vector_to_array("rawPrediction").alias("raw")
    )
    losses = []
    for t in TEMPERATURES:
        scaled = F.transform("raw", lambda x: x / t)  # noqa: B023  evaluated at once
        top = F.array_max(scaled)
        total = F.log(F.aggregate(F.transform(scaled, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)) + top
        losses.append(F.avg(total - F.get(scaled, F.col("label"))).alias(f"t{t}"))
    row = held.agg(*losses).first()
    measured = [(loss, t) for loss, t in zip(row, TEMPERATURES, strict=True) if loss is not None]
    return LicenseModel(regression, min(measured)[1] if measured else 1.0)


def _wanted(template: str) -> int:
    """How many different words and word pairs a template has."""
    found = template_words(template)
    return len({*found, *itertools.pairwise(found)})


def _overlap(of: Column, template: str) -> Column:
    """Share of the template's words and word pairs that the window has."""
    return F.size(F.array_intersect(of, F.expr(_constant(_hashed()[template][1])))) / _wanted(template)


def template_overlap(tokens: Column, family: Column) -> Column:
    """Largest share of a template's words and word pairs that the window has."""
    per_family = []
    for name, notices in sorted(TEMPLATES.items()):
        shares = [_overlap(tokens, n) for n in notices]
        per_family.append((name, F.greatest(*shares) if len(shares) > 1 else shares[0]))
    return reduce(lambda rest, x: F.when(family == x[0], x[1]).otherwise(rest), per_family, F.lit(0.0))


def template_grams(family: Column) -> Column:
    """Words and word pairs of all templates of a family."""
    per_family = [(f, dict.fromkeys(g for t in ts for g in _hashed()[t][1])) for f, ts in sorted(TEMPLATES.items())]
    return reduce(lambda rest, x: F.when(family == x[0], F.expr(_constant(x[1]))).otherwise(rest), per_family, F.array().cast("array<bigint>"))


def license_notices(docs: DataFrame, model: LicenseModel | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, paragraph, first_word, family, probability, overlap, confirmed`` of all notices found."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = model or train(texts)
    cut = windows(texts)
    names = F.array(*[F.lit(f) for f in FAMILIES])
    likely = F.filter(
        F.transform("p", lambda p, i: F.struct(p.alias("probability"), F.get(names, i).alias("family"))),
        lambda x: (x["probability"] >= LEAST) & (x["family"] != FAMILIES[0]),
    )
    judged = model.probabilities(cut).select("doc_id", "paragraph", "first_word", "tokens", "pairs", "low", "near", likely.alias("likely"))
    first = F.element_at(F.sort_array("likely", asc=False), 1)["family"]
    # a plain explode, or a filter on the array, would have the regression evaluated once more for the filter
    found = judged.withColumn("one", F.explode_outer("likely")).filter(F.col("one").isNotNull())
    each = found.select("*", "one.*").withColumn("g", F.concat("tokens", "pairs")).withColumn("first", first)
    whole = F.exists(lines(F.col("tokens"), F.col("low"), F.col("near")), lambda x: template_overlap(x, F.col("family")) >= OVERLAP)
    measured = each.filter(~F.coalesce(whole, F.lit(False))).withColumn("overlap", template_overlap(F.col("g"), F.col("family")))
    own = F.size(F.array_except(F.array_intersect("g", template_grams(F.col("family"))), template_grams(F.col("first")))) > 0
    confirmed = (F.col("overlap") >= OVERLAP) & ((F.col("family") == F.col("first")) | own)
    return measured.select("doc_id", "paragraph", "first_word", "family", "probability", "overlap", confirmed.alias("confirmed"))
