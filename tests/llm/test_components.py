import random

import pytest
from pyspark.sql import functions as F

from sitewatch.llm import components

MEMBERS = "signature long, node long, slack int"


def link(spark, rows, is_link, monkeypatch):
    """Links of ``link_groups``, and how many rows every call of ``linked`` was given.

    Rows are counted before repeated ones are dropped.
    """
    given = []
    monkeypatch.setattr(components, "_pairs", lambda df: df.toDF("a", "b"))

    def linked(pairs):
        found = [tuple(sorted(r)) for r in pairs.select("a", "b").collect()]
        given.append(len(found))
        return spark.createDataFrame(sorted({p for p in found if is_link(*p)}), "a long, b long")

    nodes = sorted({node for _, node, _ in rows})
    traits = spark.createDataFrame([(n, 1) for n in nodes], "node long, n long")
    links = components.link_groups(
        spark.createDataFrame(rows, MEMBERS), linked, traits, lambda one, other: F.col(f"{one}.n") == F.col(f"{other}.n")
    )
    return {(r["a"], r["b"]) for r in links.collect()}, given


def test_pairs_meet_seldom_more_than_once(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(s, n, 0) for s in rnd.sample(range(10**9), 60) for n in (1, 2, 3, 4, rnd.randrange(5, 10**6))]
    links, given = link(spark, rows, lambda a, b: False, monkeypatch)
    assert not links
    assert given[-1] < 700  # 60 signatures of five groups, 16 rows each, would be 960


def test_signatures_of_the_same_nodes_are_one(spark, monkeypatch):
    rows = [(s, n, 0) for s in range(50) for n in (7, 8, 9)]
    links, given = link(spark, rows, lambda a, b: False, monkeypatch)
    assert not links
    assert given[1] == 2 and given[-1] <= 6


@pytest.mark.parametrize("seed", [1, 2])
def test_every_pair_that_slacks_allow_is_asked(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    slack = {(s, n): rnd.randrange(-6, 6) for s in range(25) for n in rnd.sample(range(40), rnd.randrange(2, 9))}
    wanted = {(a, b) for s, a in slack for t, b in slack if s == t and a < b and slack[s, a] + slack[s, b] <= 0}
    true = {p for p in wanted if rnd.random() < 0.25}
    links, _ = link(spark, [(s, n, x) for (s, n), x in slack.items()], lambda a, b: (a, b) in true, monkeypatch)

    def groups(edges):
        group = {n: n for n in range(40)}
        for a, b in edges:
            old, new = group[a], group[b]
            group = {n: new if g == old else g for n, g in group.items()}
        return {frozenset(n for n in group if group[n] == g) for g in group.values()}

    assert links <= true
    assert groups(links) == groups(true)
