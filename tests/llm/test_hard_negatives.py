"""Hard negatives against scores of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewatch.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, negatives=10, low=30, high=90):
    def usable(r):
        return None not in r and all(c is not None and math.isfinite(c) for c in r[1])

    once = {}
    for i, v, label in rows:
        if usable((i, v, label)):
            label = str((label + 1) % 10 if i % 7 == 0 else label)
            x = tuple(math.floor(256 * float(np.float32(c))) for c in v)
            once[i] = min(once.get(i, (label, x)), (label, x))
    out = []
    for a in once:
        if a % 100:
            continue
        score = {b: sum(u * v for u, v in zip(once[a][1], once[b][1])) for b in once if b != a}
        clipped = {b: max(-(2**63), min(2**63 - 1, s)) for b, s in score.items()}
        ranked = sorted(clipped, key=lambda b: (-clipped[b], b))
        for p in [b for b in ranked if once[b][0] == once[a][0]][:positives]:
            hits = [b for b in ranked if once[b][0] != once[a][0] and low * clipped[p] <= 100 * clipped[b] <= high * clipped[p]]
            out += [(a, p, k + 1, b, clipped[p], clipped[b]) for k, b in enumerate(hits[:negatives])]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(4)
    df = df.withColumns({c: F.lit(1) for c in ("x", "norm", "angles", "score", "block_a", "place", "positives", "n")})
    taken = hard_negatives.scaled_rows(df, hard_negatives.every_seventh_shifted())
    out = hard_negatives.mine(taken, F.col("vec_id") % 100 == 0)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [
        ("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint"),
    ]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("clustered", [False, True])
def test_equal_to_all_pairs_over_many_blocks(spark, monkeypatch, clustered):
    monkeypatch.setattr(hard_negatives, "BLOCK", 300)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 32)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 3)
    rng = np.random.default_rng(11)
    x = rng.normal(0, 0.2, (900, 8))
    if clustered:  # narrow angles and unequal norms, so that bounds do rule pairs out
        centres = rng.normal(0, 1, (6, 8))
        x = (centres[rng.integers(0, 6, 900)] + rng.normal(0, 0.05, (900, 8))) * rng.lognormal(0, 1, (900, 1))
    rows = [(i, x[i].tolist(), int(rng.integers(0, 3))) for i in range(900)]
    got = mined(spark, rows)
    assert got == plain(rows) and got


def test_tiles_are_ruled_out_before_scoring(spark, monkeypatch):
    """On clusters far apart most pairs never get an integer score."""
    asked = []
    score = hard_negatives._scores
    monkeypatch.setattr(hard_negatives, "_scores", lambda a, r, one, other: asked.append(len(one)) or score(a, r, one, other))
    rng = np.random.default_rng(2)
    x = np.repeat(np.eye(8), 64, axis=0) * 2 + rng.normal(0, 0.01, (512, 8))
    stored = hard_negatives.with_angles(
        spark.createDataFrame([(i, "1", (256 * v).round().tolist()) for i, v in enumerate(x)], "vec_id long, label string, x array<double>")
    )
    side = hard_negatives._Side(stored.toArrow(), "vec_id")
    found = hard_negatives._Best(512, 5, np.full(512, 200_000))
    list(hard_negatives._tiles(side, side.ordered(), lambda: (found.worst.astype(float), np.full(512, np.inf))))
    assert sum(asked) < 512 * 512 / 4


def test_ties_nulls_ragged_repeated_and_negative_scores(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (100, [-1.0, 0.5], 2), (200, [0.0, 0.0], 3)]
    rows += [(i, [0.5, 0.25], 1 + i % 3) for i in range(1, 30)]  # ties
    rows += [(i, [-0.5, 0.1 * (i % 4)], i % 3) for i in range(31, 60)]
    rows += [(61, [0.75], 2), (62, [], 2), (63, None, 1), (64, [nan, 1.0], 1), (65, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (66, [None, 1.0], 1)]
    rows += [(1, [0.5, 0.25], 2)] * 3 + [(100, [2.0, 2.0], 2), (2, [1.0, 1.0], 0)]
    assert mined(spark, rows) == plain(rows)


def test_huge_components_and_empty_tables(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [1e38, 1.0], 1), (2, [2e38, 0.0], 2), (3, [1.0, 1.0], 2), (4, [-3e38, 1.0], 2), (5, [1e19, 0.5], 1)]
    assert mined(spark, rows) == plain(rows)
    beyond = [(0, [1e307, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1e307, 1.0], 2)]
    assert mined(spark, beyond, "vec_id long, embedding array<double>, label int") == []
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
