"""Licence notices in a corpus of invented words."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sheetwise.catalog.registry import table
from sheetwise.llm.license_scan import TEMPLATES, license_notices, template_grams, template_overlap, train, windows
from tests.conftest import SF

NOTICES = {
    "mit": "Released under the MIT License.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
}


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "li", "cen", "se", "mo", "ver", "un", "der"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(3)
    rows, wanted = [(0, None), (1, ""), (2, "\n \n..."), (3, "The license of the software is free for all")], set()
    for i in range(10, 400):
        lines = [prose(rng, rng.randint(3, 120)) for _ in range(rng.randint(1, 4))]
        if i % 4 == 0:
            family = rng.choice(sorted(NOTICES))
            at = rng.randrange(len(lines) + 1)
            lines.insert(at, NOTICES[family] if i % 8 else f"{prose(rng, 45)} {NOTICES[family].upper()} {prose(rng, 30)}")
            wanted.add((i, at, family))
        rows.append((i, "\n".join(lines)))
    rows.append((500, f"{NOTICES['mit']}\n{prose(rng, 20_000)}\n{NOTICES['gpl']}"))
    wanted |= {(500, 0, "mit"), (500, 2, "gpl")}
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, label string, p int")
    model = train(docs)
    return docs, model, license_notices(docs, model), wanted


def notices_windows(found) -> int:
    return windows(found[0].select("doc_id", "text")).count()


def test_notices(found):
    _, _, notices, wanted = found
    rows = notices.collect()
    confirmed = {(r["doc_id"], r["paragraph"], r["family"]) for r in rows if r["confirmed"]}
    assert confirmed == wanted
    assert all(0.1 <= r["probability"] <= 1 and 0 <= r["overlap"] <= 1 for r in rows)
    texts = notices_windows(found)
    assert sum(not r["confirmed"] for r in rows) <= 0.01 * texts


def test_every_template_is_its_own_family(spark, found):
    _, model, _, _ = found
    rows = [(i, t, f) for i, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    named = license_notices(spark.createDataFrame(rows, "doc_id long, text string, family string"), model).collect()
    assert {(r["doc_id"], r["family"]) for r in named if r["confirmed"]} == {(i, f) for i, _, f in rows}


def test_empty_table_and_plan(spark, found, plan_of):
    docs, model, _, _ = found
    assert license_notices(docs.limit(0), model).count() == 0
    plan = plan_of(license_notices(table(spark, SF, "documents"), model))
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


WRAPPED = {
    "gpl": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or""",
    "cc-by-nc": "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.",
    "apache-2.0": """ # you may not use this file except in compliance with the License.
 # You may obtain a copy of the License at""",
}


def test_wrapped_notices(spark, found):
    rng, rows = random.Random(5), []
    for i, (family, notice) in enumerate(sorted(WRAPPED.items())):
        rows.append((i, f"{prose(rng, 30)}\n\n{notice}\n\n{prose(rng, 30)}", family))
        rows.append((i + 10, f"{prose(rng, 30)}\n{prose(rng, 5)} {notice}\n{prose(rng, 50)}", family))
    rows.append((30, "This work is licensed under a Creative Commons\n \nAttribution-NonCommercial 4.0 International License.", None))
    notices = license_notices(spark.createDataFrame(rows, "doc_id long, text string, family string"), found[1]).collect()
    confirmed = {(r["doc_id"], r["family"]) for r in notices if r["confirmed"]}
    assert confirmed == {(i, f) for i, _, f in rows if f}


def test_two_licences_of_one_window(spark, found):
    rows = [
        (0, "Licensed under the MIT License or the Apache License, Version 2.0.", ["mit", "apache-2.0"]),
        (1, "Licensed under the Apache License, Version 2.0 or\nreleased under the MIT License, at your option.", ["mit", "apache-2.0"]),
        (2, "Licensed under the GNU General Public License, version 2. Licensed under the Mozilla Public License, Version 2.0", ["gpl", "mpl-2.0"]),
        (3, "Licensed under the GNU Lesser General Public License, version 3", ["lgpl"]),
    ]
    notices = license_notices(spark.createDataFrame(rows, "doc_id long, text string, families array<string>"), found[1]).collect()
    confirmed = {(r["doc_id"], r["family"]) for r in notices if r["confirmed"]}
    assert confirmed == {(i, f) for i, _, fs in rows for f in fs}


def test_templates_are_constants_of_the_plan(spark):
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    cut = windows(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"))
    family = F.get(F.array(*[F.lit(f) for f, _ in rows]), F.col("doc_id").cast("int"))
    g = F.concat("tokens", "pairs")
    of_family = (template_overlap(g, family), template_grams(family))
    assert "xxhash64" not in f"{of_family}"
    measured = cut.select(of_family[0].alias("overlap"), F.size(F.array_except(g, of_family[1])).alias("others")).collect()
    assert [(r["overlap"], r["others"]) for r in measured] == [(1.0, 0)] * len(rows)
