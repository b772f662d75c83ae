"""Ids against the tokenizers library, decoding against its own and as a round trip."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheetwise.llm import byte_bpe
from sheetwise.llm.queries import QUERIES, byte_tokenizer
from tests.conftest import SF

TEXTS = [
    None, "", " ", "  ", "a", "Hello, WORLD. don't you'll 'story !'s x's", "tab\t\tx \n\n y\r\n z  ", "  x   b à la  à",
    " 　 \x85 x \x1c y​", "<|endoftext|>", "a  <|endoftext|> b<|endoftext|><|endoftext|>c <|endoftext", "1234567 12a3 ¼½ ٣٤ 五",
    "日本語のテキスト、漢字。 한국어 русский ελληνικά 🙂🙂🙂 👩‍👩‍👧", "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "é" * 500, "=" * 700 + " " * 600 + "x",
    "same", "same", "İı ﬁ ǅ ʰ ª º", "ThereAreCamelCaseWords_and_snake_case(x)[0]{y}->z;//" * 30,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_tokenizer())


@pytest.fixture(scope="module")
def model():
    return byte_bpe.ByteBPE(byte_tokenizer())


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def noise(rng: random.Random) -> str:
    words = ["the", " ", "  ", "\n", "\t", "'s", "'", "’", "é", "à", " ", "123", "Don't", ",", "...", "<|endoftext|>", "🙂", "ß", "zq", "Ünder", "x" * 50, "　", "&amp;", "-", "\x00", "\x7f"]
    return "".join(rng.choice(words) if rng.random() < 0.8 else chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0x24FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(rng.randint(0, 120)))


def test_ids_equal_the_library(model, library):
    rng = random.Random(7)
    texts = [t or "" for t in TEXTS] + [noise(rng) for _ in range(3000)]
    found = model.encode([t.encode() for t in texts])
    for text, data in zip(texts, found, strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids(data) == wanted, repr(text)
        assert model.decode(data).decode() == library.decode(wanted, skip_special_tokens=False) == text


def test_decoding_of_any_ids(model, library):
    rng = random.Random(8)
    for _ in range(500):
        some = [rng.randrange(50257) for _ in range(rng.randint(0, 30))]
        assert model.decode(np.array(some, "<u4").tobytes()).decode(errors="replace") == library.decode(some, skip_special_tokens=False)


def test_forced_pairs_are_in_no_token(model, library):
    for i in range(50256):
        token = model.spelling[model.starts[i] : model.starts[i] + model.lengths[i]].tobytes()
        assert not len(token) > 1 or not len(model.cuts(token, model.forced))
    assert 10_000 < model.forced.sum() < 65_536


def test_long_fragments_and_long_texts(model, library, monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(30_000)), "word, other words. " * 3000, " " * 5000, "ab" * 4000]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(byte_bpe, "BYTES_AT_ONCE", 1000)
    monkeypatch.setattr(byte_bpe, "IDS_AT_ONCE", 999)
    monkeypatch.setattr(byte_bpe, "PARTS_KEPT", 3)
    found = model.encode([t.encode() for t in texts])
    assert [ids(x) for x in found] == wanted
    assert [model.decode(x).decode() for x in found] == texts


def test_columns(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, n_tokens int")
    rows = docs.withColumn("found", byte_bpe.ids_of(F.col("text"), byte_tokenizer())).withColumn("back", byte_bpe.text_of(F.col("found"), byte_tokenizer()))
    for row in rows.collect():
        assert ids(row["found"]) == library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["back"] == (row["text"] or "") and row["ids"] == "x"
    assert rows.limit(0).count() == 0


def test_query_encodes_each_text_once(spark, library, plan_of):
    found = QUERIES["op12_bpe"](spark, SF)
    assert plan_of(found).count("ArrowEvalPython") <= 4  # two nodes, each named twice
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = found.collect()
    assert len(rows) == len(texts)
    for row in rows:
        wanted = np.array(library.encode(texts[row["doc_id"]], add_special_tokens=False).ids, "<u4")
        assert row["n_tokens"] == len(wanted)
        assert row["ids_sha256"] == hashlib.sha256(wanted.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
