"""Whitening against one dense computation in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, k):
    x = np.floor(256 * np.array(vectors, dtype=np.float32).astype(float))
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors / np.sqrt(values), values / np.trace(cov)


def collected(df, ids, k):
    table = {(r["vec_id"], r["component"]): r for r in df.collect()}
    return table, np.array([[table[i, c + 1]["whitened"] for c in range(k)] for i in ids])


@pytest.mark.parametrize("block", [7, 1024])
def test_equal_to_numpy_with_copies_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    monkeypatch.setattr(whitening, "BLOCKS_PER_SPLIT", 2)
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (150, 6)) * [5, 3, 2, 1, 0.5, 0.2]
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 80, axis=0)]).tolist()
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("id", "x", "number", "values", "n", "ids")})
    got = whitening.whitened_rows(df)
    table, z = collected(got, range(len(vectors)), 4)
    n, deviation, want, explained = plain(vectors, 4)
    assert len(table) == got.count() == 4 * len(vectors)
    signs = np.sign((z * want).sum(axis=0))
    assert np.allclose(z, want * signs, rtol=1e-8, atol=1e-8)
    assert [table[i, 1]["deviation"] for i in range(len(vectors))] == deviation.astype(int).tolist()
    assert {r["n"] for r in table.values()} == {n}
    assert np.allclose([table[0, c + 1]["explained"] for c in range(4)], explained, rtol=1e-9)
    assert max(r["identity_error"] for r in table.values()) < 1e-9


def test_unusable_ragged_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (None, [0.1, -0.5], None), (4, [0.9], 2), (5, None, 1), (6, [nan, 0.0], 1), (7, [inf, 0.0], 1), (8, [None, 0.0], 1), (9, [], 0)]
    got = whitening.whitened_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    ids = sorted((r["vec_id"] for r in got if r["component"] == 1), key=repr)
    assert ids == [1, 1, 4, 9, None] and {r["component"] for r in got} == {1, 2}
    n, deviation, want, _ = plain([[0.5, 0.25], [0.1, -0.5], [0.9, 0.0], [0.0, 0.0]], 2)
    at = {1: 0, None: 1, 4: 2, 9: 3}
    assert all(r["n"] == n and r["deviation"] == deviation[at[r["vec_id"]]] for r in got)
    assert all(abs(abs(r["whitened"]) - abs(want[at[r["vec_id"]], r["component"] - 1])) < 1e-9 for r in got)


def test_no_rows_equal_rows_and_huge_entries(spark):
    assert whitening.whitened_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened_rows(spark.createDataFrame([(1, [], 1), (2, None, 1)], SCHEMA)).count() == 0
    same = whitening.whitened_rows(spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(3)], SCHEMA)).collect()
    assert {(r["whitened"], r["deviation"], r["explained"]) for r in same} == {(None, 0, 0.0)} and len(same) == 6
    huge = whitening.whitened_rows(spark.createDataFrame([(1, [3e38, 1.0], 1), (2, [-3e38, 2.0], 1)], SCHEMA)).collect()
    assert [r["deviation"] for r in huge] == [None] * 4
    wide = whitening.whitened_rows(spark.createDataFrame([(1, [1e4, 1.0], 1), (2, [-1e4, 2.0], 1)], "vec_id long, embedding array<double>, label int")).collect()
    assert {r["deviation"] for r in wide} == {5120000**2 + 256**2}
