"""URL rules against a direct reading of the rules."""

from __future__ import annotations

import random

import pytest

from sheetwise.llm.url_filter import url_verdicts

RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/es/"), ("allow", "net", "/es/ok"), ("block", "Shop.net", None),
    ("block", None, "/x"),
]


def judged(url: str | None):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest[: min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))]
        rest = rest[len(host) :]
        path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule_host, rule_path in RULES:
        if rule_host is None:
            continue
        rule_host, rule_path = rule_host.lower(), rule_path or ""
        fits = host == rule_host or host.endswith("." + rule_host)
        key = (len(rule_host + rule_path), len(rule_host), verdict)
        if fits and path.startswith(rule_path) and (best is None or key > best[0]):
            best = (key, rule_host + rule_path, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "verdict string, host string, path string")


def run(spark, rules, urls):
    pages = spark.createDataFrame(
        [(i, u, "x", "y", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, key int"
    )
    found = url_verdicts(pages, rules).collect()
    return {r["page_id"]: tuple(r)[1:] for r in found}, len(found)


def test_against_direct_reading(spark, rules):
    rng = random.Random(5)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "WWW.EXAMPLE.com", "xexample.com", "net",
             "b.net", "shop.net", "x.shop.net", "comx", "", "exämple.com", "example.com.", "example.com:80"]
    paths = ["", "/", "/en/", "/en", "/en/1", "/es/", "/es/okay", "/es/1", "/fr/\n"]
    urls = [
        rng.choice(["http://", "https://", "x", "://", ""]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/en/", "#t", "?a://b/"])
        for _ in range(600)
    ]
    urls += [None, "", "://", "a" * 50_000, "http://example.com/en/" + "p" * 50_000, "no scheme"]
    found, rows = run(spark, rules, urls)
    assert rows == len(urls)
    assert found == {i: judged(u) for i, u in enumerate(urls)}


def test_one_url_in_most_rows(spark, rules):
    urls = ["http://www.example.com/en/1"] * 3000 + [f"http://h{i}.net/es/{i}" for i in range(300)]
    found, rows = run(spark, rules, urls)
    assert rows == 3300 and found == {i: judged(u) for i, u in enumerate(urls)}


def test_empty_tables(spark, rules):
    assert run(spark, rules, []) == ({}, 0)
    found, _ = run(spark, rules.limit(0), ["http://a.com/"])
    assert found == {0: ("a.com", "/", None, "allow")}


def test_names_of_the_result_are_taken(spark, rules):
    pages = spark.createDataFrame([(1, "u")], "host long, url string")
    with pytest.raises(ValueError):
        url_verdicts(pages, rules, keep=("host",))
