"""URL rules against a plain loop over all rules."""

import random

import pytest
from pyspark.sql import functions as F

from sitewatch.llm import url_filter

RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "ads.example.com", "/fr/"), ("allow", "example.com", "/de/ok"),
    ("block", "x.org", ""), ("allow", "X.org", ""), ("block", None, "/"), ("block", "a.b.c.d.net", "/a/b/c"),
]


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, h, p in rules:
        if h is None or p is None:
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h) + len(p), len(h), h + p, verdict == "block"))
    return host, path, best and best[2], default if best is None else "block" if best[3] else "allow"


def urls():
    rng = random.Random(5)
    hosts = ["org", "example.org", "www.Example.org", "badexample.org", "com", "ads.example.com", "example.com", "x.org", "z.a.b.c.d.net", "b.c.d.net", "é.org", ".org", "example.org:80", "u@example.org", "a..com", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/17.html", "/en/", "/fr/x", "/de/ok/1", "/de/", "/a/b/c", "/ES/", "/es/://org/", "//"]
    out = [f"{rng.choice(['http', 'https', ''])}://{h}{p}{rng.choice(['', '?q=/es/', '#x', '?a#b'])}" for h in hosts for p in paths]
    return out + [None, "", "example.org/es/", "mailto:x", "http:/example.org/es/", "http://" + "a." * 5000 + "org/" + "x" * 50_000, "http://example.org\n/es/"]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_equal_to_a_loop_over_rules(spark, broadcast):
    every = urls() * 2
    pages = spark.createDataFrame([(None if i % 50 == 7 else i, u) for i, u in enumerate(every)], "page_id long, url string")
    pages = pages.withColumns({name: F.lit(1) for name in ("id", "host", "path", "verdict", "rule", "digest", "times", "k")})
    rules = url_filter.rule_table(spark, RULES)
    got = url_filter.judge_urls(pages.repartition(5), rules, broadcast_rules=broadcast)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = sorted([(None if i % 50 == 7 else i, *plain(u, RULES)) for i, u in enumerate(every)], key=repr)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want


def test_no_rules_empty_pages_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "STEP", 3)
    none = url_filter.rule_table(spark, [])
    pages = spark.createDataFrame([(1, "http://a.org/")] * 10 + [(2, None)], "page_id long, url string")
    got = [tuple(r) for r in url_filter.judge_urls(pages, none, default="block").collect()]
    assert sorted(got, key=repr) == sorted([(1, "a.org", "/", None, "block")] * 10 + [(2, "", "", None, "block")], key=repr)
    empty = pages.limit(0)
    assert url_filter.judge_urls(empty, url_filter.rule_table(spark, RULES)).count() == 0


@pytest.mark.parametrize("default", ["allow", "block"])
def test_whole_rows_are_kept(spark, default):
    every = urls()
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(every)], "page_id long, url string, host string")
    kept = url_filter.drop_blocked(pages, url_filter.rule_table(spark, RULES), default=default)
    assert kept.columns == pages.columns
    assert {r["page_id"] for r in kept.collect()} == {i for i, u in enumerate(every) if plain(u, RULES, default)[3] == "allow"}


def test_main_path_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = url_filter.judge_urls(pages, url_filter.rule_table(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
