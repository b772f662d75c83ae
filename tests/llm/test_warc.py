"""Archives written and read back."""

from __future__ import annotations

import glob
import gzip
import hashlib
import io

import pytest

from sheetwise.llm import warc
from sheetwise.llm.warc import archive_folder, read_archives, read_records, record_bytes, write_archives

LONG = "<p>" + "é" * 60 + "</p>"
ROWS = [
    (5, "http://a/", LONG), (2, "http://b/\r\nX: y", LONG), (7, None, LONG), (2, "http://b/", LONG), (None, "u", LONG),
    (8, "http://c/", "short"), (9, "http://d/", "short"), (10, "http://e/", None), (11, "http://f/", ""),
    (12, "ü", "x" * 300_000), (13, "http://g/", "only " * 50),
]


@pytest.fixture(scope="module")
def back(spark):
    pages = spark.createDataFrame([(*r, "t") for r in ROWS], "page_id long, url string, html string, payload string")
    folder = archive_folder(spark)
    manifest = write_archives(pages, folder)
    return folder, manifest, read_archives(manifest, folder, payloads=True).collect()


def test_round_trip(back):
    _, manifest, rows = back
    assert len(rows) == len(ROWS) == sum(r["records"] for r in manifest.collect())
    wanted = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        revisit = data == LONG.encode() and page != 2
        wanted.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                       2 if revisit else None, None if revisit else data.decode()))
    assert sorted(map(tuple, rows), key=repr) == sorted(wanted, key=repr)


def test_archives_are_gzip_members(back):
    folder, _, _ = back
    files = glob.glob(folder.removeprefix("file://") + "/*.warc.gz")
    records = sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files)
    members = sum(open(f, "rb").read().count(b"\x1f\x8b\x08") for f in files)
    assert records == len(ROWS) and members >= len(ROWS)


def test_damage_is_found():
    good = record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, 6)
    assert [p for _, _, p in read_records(io.BytesIO(good + good))] == [b"payload"] * 2
    wrong = record_bytes(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None, False, 6)
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(wrong)))
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(good[:-12])))
    plain = gzip.decompress(good).replace(b"Content-Length: 7", b"Content-Length: 6")
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(gzip.compress(plain))))


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = archive_folder(spark)
    assert read_archives(write_archives(pages, folder), folder).count() == 0


def test_folder_is_on_the_default_file_system(spark, monkeypatch):
    monkeypatch.setattr(warc, "scratch_path", lambda spark, name: f"/checkpoints/a b/{name}")
    assert archive_folder(spark) == "file:///checkpoints/a b/warc"
    conf = spark._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://127.0.0.1:9000")
    try:
        assert archive_folder(spark) == "hdfs://127.0.0.1:9000/checkpoints/a b/warc"
    finally:
        conf.set("fs.defaultFS", old)
