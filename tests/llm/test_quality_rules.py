"""Counts against a slow count, and verdicts on hosts."""

from __future__ import annotations

import random
import re

import pytest

from sheetwise.llm.quality_rules import measure_text, quality_rules, quality_rules_stage


def slow(text: str | None):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
        len(lines) - len(set(lines)), len(repeated),
    )


TEXTS = [
    None, "", " ", "\n\n", "a b c d e f", "a b c d e a b c d e", "x " * 40, "é\u00a0ü \u2003 ß\x1c\x85 z",
    "same line\nsame line\n  \nsame line \n", "#*$%&|<> text " * 9, "w" * 100_000, "\r\n\x0b\x0c\t",
]


def test_counts():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["\n".join(rng.choice(["x y", "", " ", "z"]) for _ in range(8)) for _ in range(100)]
    for text in TEXTS + texts:
        assert measure_text(text) == slow(text), repr(text)[:80]


@pytest.fixture(scope="module")
def docs(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, t, "h", 0, 1) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, "bad", "spam", 0, 1) for i in range(300)] + [(500, good, "spam", 0, 1)]
    rows += [(600 + i, good, "fine", 0, 1) for i in range(300)] + [(900, good, None, 0, 1), (901, "bad", None, 0, 1)]
    rows += [(902, "bad", "tiny", 0, 1), (903, good, "tiny", 0, 1), (600, good, "fine", 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, host int, rejected_host int")


def test_host_verdicts(docs):
    rows = quality_rules(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r["measured"] for r in rows}
    for i, text in enumerate(TEXTS):
        m = by_id[i]
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_lines, m.n_dup_lines, m.n_repeat_words) == slow(text)
        assert m.base_failed == (m.n_words < 10 or 100 * m.n_repeat_words > 20 * m.n_words)
        assert not (m.kept and m.base_failed)
    assert not by_id[500].kept and not by_id[500].base_failed  # a good text of a bad host
    assert by_id[600].kept and by_id[900].kept and not by_id[901].kept
    assert by_id[903].kept  # one failure of two does not condemn a host


def test_stage_keeps_columns(docs):
    kept = quality_rules_stage(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {600, 900, 903}
    assert quality_rules_stage(docs.limit(0)).count() == 0


def test_name_of_the_result_is_taken(docs):
    with pytest.raises(ValueError):
        quality_rules(docs.withColumnRenamed("host", "measured"))
