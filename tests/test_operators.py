"""Edge cases on hand-made rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewatch import constants as C
from sitewatch.config import FeatureSettings, GateSettings, ScoringSettings
from sitewatch.functions import geo, numeric, text
from sitewatch.operators import cleaning, features, feed, gates, narrative, neighbours, peers, pressures
from sitewatch.operators import scoring, skew, spatial, statistics
from sitewatch.operators.order_statistics import average_ranks, grouped_quantiles, quantile


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- order statistics -------------------------------------------------------------


def test_quantiles_match_numpy_on_skewed_groups(spark):
    rng = np.random.default_rng(7)
    data = {
        "big": np.concatenate([rng.normal(0, 100, 3000), np.zeros(2000)]),
        "neg": -rng.lognormal(0, 3, 500),
        "one": np.array([4.25]),
        "int": rng.integers(0, 5, 1000).astype(float),
    }
    table = [(k, float(v)) for k, values in data.items() for v in values] + [("none", None), ("big", math.nan)]
    df = spark.createDataFrame(table, "g string, v double").repartition(7)
    got = {
        r["g"]: r
        for r in grouped_quantiles(
            df, ["g"], "v", {"m": (0.5, "linear"), "lo": (0.1, "nearest"), "p95": (0.95, "linear")}
        ).collect()
    }
    assert set(got) == set(data)
    for name, values in data.items():
        ordered = np.sort(values)
        at = int(math.floor(0.1 * (len(values) - 1) + 0.5))
        assert got[name]["m"] == pytest.approx(np.median(values))
        assert got[name]["lo"] == ordered[at]
        assert got[name]["p95"] == pytest.approx(np.percentile(values, 95))


def test_quantile_group_key_may_be_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = rows(grouped_quantiles(df, ["g"], "v", {"m": (0.5, "linear")}), "g", "m")
    assert got == [("a", 5.0), (None, 2.0)]


def test_ranks_average_ties_and_skip_null(spark):
    df = spark.createDataFrame(
        [("a", 3.0), ("b", 3.0), ("c", 9.0), ("d", -1.0), ("e", None), ("f", 0.0), ("g", -0.0)],
        "site_id string, s double",
    )
    got = dict(rows(average_ranks(df, "s", "r"), "site_id", "r"))
    assert got == {"c": 1, "a": 2, "b": 2, "f": 4, "g": 4, "d": 6, "e": None}
    assert quantile(df, "s", 0.5).first()[0] == 1.5


def test_order_bits_are_those_of_the_double(spark):
    import struct

    from sitewatch.functions.numeric import order_bits

    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, math.inf, 1.0]
    values += [2.0**e for e in range(-1074, 1024)]
    values += [math.nextafter(2.0**e, to) for e in range(-1022, 1024) for to in (0.0, math.inf)]
    values += (rng.normal(0, 1, 3000) * 10.0 ** rng.integers(-300, 300, 3000)).tolist()
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, bits in df.select("v", order_bits(F.col("v"))).collect():
        want = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert bits == (-want if v < 0 else want), v


def _close_values(n):
    """Groups whose values lie within 1e-9 of each other, or are neighbouring doubles."""
    rng = np.random.default_rng(4)
    step = math.ulp(3.0)
    return {
        None: (1.0 + rng.random(n) * 1e-9).tolist(),
        "neighbours": [3.0 + step * int(i) for i in rng.permutation(n)],
        "negative": (-5e-320 * rng.integers(0, n, n)).tolist(),
        "mixed": rng.normal(0, 1, n).tolist() + [2.5] * n,
        "tiny": [7.0],
    }


def test_quantiles_of_close_values_sort_little_at_a_time(spark, monkeypatch):
    from sitewatch.operators import order_statistics

    limit, sorted_parts = 30, []
    monkeypatch.setattr(order_statistics, "SORTED_VALUES", limit)
    plain = order_statistics._sorted_bins

    def spied(rows, bins, keys, slots):
        joined = order_statistics._to_bins(rows.select(*keys, "_bin", "_value", "_count"), bins, keys)
        sorted_parts.extend(r["count"] for r in joined.groupBy(*keys, "_bin").count().collect())
        return plain(rows, bins, keys, slots)

    monkeypatch.setattr(order_statistics, "_sorted_bins", spied)
    data = _close_values(1500)
    df = spark.createDataFrame([(g, v) for g, values in data.items() for v in values], "g string, v double").repartition(6)
    specs = {"m": (0.5, "linear"), "lo": (0.1, "nearest"), "p95": (0.95, "linear"), "top": (1.0, "linear")}
    for broadcast in (100_000, 0):
        monkeypatch.setattr(order_statistics, "BROADCAST_BINS", broadcast)
        got = {r["g"]: r for r in grouped_quantiles(df, ["g"], "v", specs).collect()}
        for name, values in data.items():
            ordered = np.sort(values)
            assert got[name]["lo"] == ordered[int(math.floor(0.1 * (len(ordered) - 1) + 0.5))]
            for column, q in (("m", 0.5), ("p95", 0.95), ("top", 1.0)):
                assert got[name][column] == pytest.approx(np.quantile(ordered, q), rel=1e-15, abs=0)
    assert max(sorted_parts) <= limit
    one = spark.createDataFrame([(v,) for v in data["neighbours"]], "v double")
    assert quantile(one, "v", 0.25).first()[0] == pytest.approx(np.quantile(data["neighbours"], 0.25), rel=1e-15)


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_of_close_values_come_from_even_ranges(spark, monkeypatch, descending):
    from sitewatch.operators import order_statistics

    monkeypatch.setattr(order_statistics, "RANGE_VALUES", 200)
    monkeypatch.setattr(order_statistics, "SPLIT_ROWS", 100)
    for name, values in _close_values(1500).items():
        table = [(i, v, {"a": 1}) for i, v in enumerate([*values, None, math.nan])]
        df = spark.createDataFrame(table, "i long, s double, m map<string,int>").repartition(5)
        ranges = order_statistics.value_ranges(df, "s", descending)
        assert all(r["count"] <= 600 for r in ranges.groupBy("_range").count().collect())
        got = {r["i"]: r["rank"] for r in order_statistics.fractional_ranks(df, "s", "rank", descending).collect()}
        _, place, count = np.unique(np.array(values) * (-1 if descending else 1), return_inverse=True, return_counts=True)
        want = (np.cumsum(count) - count + (count + 1) / 2)[place]
        assert [got[i] for i in range(len(values))] == want.tolist(), name
        assert got[len(values)] is None and got[len(values) + 1] is None and len(got) == len(table)


# --- cleaning ------------------------------------------------------------------------


def _raw(spark, values, determinant="pH"):
    return spark.createDataFrame([(v, determinant) for v in values], "result_raw string, determinant string")


def test_parse_censored_edges(spark):
    values = ["<0.5", " 7.1 ", "12d", "NaN", "inf", "1e2", "", "<", None, "< 3", "-2", ".5", "\t4\n"]
    got = [
        (r["is_left_censored"], r["value"])
        for r in cleaning.parse_censored(_raw(spark, values)).collect()
    ]
    assert got == [
        (True, 0.25), (False, 7.1), (False, None), (False, None), (False, None), (False, 100.0), (False, None),
        (True, None), (None, None), (True, 1.5), (False, -2.0), (False, 0.5), (False, 4.0),
    ]


def test_values_are_parsed_once_in_filter_and_projection(spark):
    raw = _raw(spark, ["1", "2"]).withColumn("sample_material", F.lit("RIVER / RUNNING SURFACE WATER"))
    raw = raw.withColumns({"unit": F.lit("mg/l"), "site_id": F.lit("s"), "sample_datetime": F.lit("2000-01-01T00:00:00")})
    plan = cleaning.clean_observations(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract") <= 2


def test_negative_alkalinity_is_clamped(spark):
    got = cleaning.parse_censored(_raw(spark, ["-3", "3", "x"], C.CLAMPED_DETERMINAND)).collect()
    assert [r["value"] for r in got] == [0.0, 3.0, None]


def test_range_filter_follows_three_valued_logic(spark):
    df = spark.createDataFrame(
        [(C.TEMPERATURE_DETERMINAND, 46.0), (C.TEMPERATURE_DETERMINAND, None), ("pH", None), ("pH", 99.0)],
        "determinant string, value double",
    )
    assert rows(cleaning.physical_range_filter(df), "determinant", "value") == [("pH", 99.0), ("pH", None)]


def test_harmonise_merges_two_generations_and_requires_columns(spark):
    df = spark.createDataFrame(
        [("A", None, "0076", "t", "7", "mg/l", "2020-01-01", "m")],
        "`samplingPoint.notation` string, `sample.samplingPoint.notation` string, `determinand.notation` string,"
        "`determinand.prefLabel` string, result string, unit string, phenomenonTime string, sampleMaterialType string",
    )
    assert cleaning.harmonise_columns(df).first()["determinand_code"] == "0076"
    with pytest.raises(cleaning.MissingColumns):
        cleaning.harmonise_columns(df.drop("result"))


# --- statistics and features -----------------------------------------------------------


def test_stats_merge_names_and_single_values(spark):
    df = spark.createDataFrame(
        [("s", "1", "u", "b name", 1.0), ("s", "1", "u", "a name", 4.0), ("s", "1", "u", "a name", 7.0),
         ("t", "1", None, None, 5.0)],
        "site_id string, determinand_code string, unit string, determinant string, value double",
    ).withColumn("sample_dt", F.lit("2020-05-05").cast("timestamp_ntz")).withColumn("year", F.lit(2020))
    got = {r["site_id"]: r for r in statistics.site_determinand_stats(df).collect()}
    assert (got["s"]["n"], got["s"]["mean"], got["s"]["median"]) == (3, 4.0, 4.0)
    assert got["s"]["std"] == pytest.approx(3.0) and got["s"]["determinant"] == "a name"
    assert got["t"]["std"] is None and got["t"]["median"] == 5.0 and got["t"]["determinant"] is None


def test_whole_days_are_not_calendar_days(spark):
    df = spark.createDataFrame([("s", "2020-01-01 23:00:00", 1.0), ("s", "2020-01-03 22:00:00", 1.0)],
                               "site_id string, t string, value double")
    df = df.withColumn("sample_dt", F.col("t").cast("timestamp_ntz"))
    assert statistics.site_coverage(df).first()["avg_days_between_visits"] == 0.5
    assert statistics.site_coverage(df, None).first()["first_sample"] is None


def test_impute_scale_and_embedding(spark):
    grid = spark.createDataFrame(
        [(f"s{i}", f, None if (i, f) == (0, "a") else float(i * k))
         for i in range(6) for f, k in (("a", 1), ("b", 2), ("c", 0))],
        "site_id string, feature string, value double",
    )
    filled = features.impute_median(grid)
    assert filled.where("is_imputed").first()["value"] == 3.0
    scaled = features.standard_scale(filled)
    assert all(r["value"] == 0.0 for r in scaled.where("feature = 'c'").collect())
    embedded = features.embed_2d(scaled)
    assert embedded.count() == 6
    again = features.embed_2d(scaled.repartition(5))
    a, b = ({r["site_id"]: r["umap_x"] for r in d.collect()} for d in (embedded, again))
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_feature_columns_fall_back_by_type(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0, 1, "x")], "site_id string, lat double, Zinc double, Zinc_z int, note string")
    assert features.feature_columns(df, {"1": "absent"}) == ["Zinc"]
    assert features.feature_columns(df, {}, ["Zinc", "gone"]) == ["Zinc"]
    assert features.z_columns(df) == ["Zinc_z"]


def test_no_features_is_an_error(spark):
    stats = spark.createDataFrame([("s", "x", "u", 3, 1.0, "n")],
                                  "site_id string, determinand_code string, unit string, n long, median double, determinant string")
    with pytest.raises(features.NoFeatures):
        features.select_features(stats, FeatureSettings())


def test_typology_without_lookup(spark):
    sites = spark.createDataFrame([("s",)], "site_id string")
    assert features.typology_join(sites, None).first()["wfd_type"] is None
    assert features.typology_join(sites, sites).first()["wfd_type"] is None


# --- scoring -------------------------------------------------------------------------------


def test_small_and_missing_types_use_all_sites(spark):
    sites = spark.createDataFrame(
        [(f"s{i}", "big" if i < 4 else ["", "nan", None, "tiny"][i - 4]) for i in range(8)], "site_id string, wfd_type string"
    )
    long = spark.createDataFrame([(f"s{i}", "f", float(i)) for i in range(8)], "site_id string, feature string, value double")
    got = {r["site_id"]: r for r in scoring.peer_zscores(long, sites, 3).collect()}
    assert got["s0"]["z"] == pytest.approx((0 - 1.5) / np.std([0, 1, 2, 3]))
    assert {got[f"s{i}"]["score_reference"] for i in range(4, 8)} == {"global"}
    assert got["s7"]["score_peer_group_size"] == 8


def test_unknown_method_warns_and_uses_typology(spark, caplog):
    sites = spark.createDataFrame([(f"s{i}", 50.0 + i, 0.0, "t") for i in range(5)],
                                  "site_id string, lat double, lon double, wfd_type string")
    long = spark.createDataFrame([(f"s{i}", "f", float(i * i)) for i in range(5)],
                                 "site_id string, feature string, value double")
    out = scoring.score_sites(long, sites, ScoringSettings(method="historical_self"))
    assert "geo_anomaly_score" not in out.columns and "unknown scoring method" in caplog.text
    assert out.where("is_flagged").count() == 1


def test_geo_scores_are_null_without_coordinates(spark):
    sites = spark.createDataFrame([(f"s{i}", None if i == 0 else 50.0 + i / 10, 0.0, "t") for i in range(6)],
                                  "site_id string, lat double, lon double, wfd_type string")
    long = spark.createDataFrame([(f"s{i}", "f", float(i)) for i in range(6)],
                                 "site_id string, feature string, value double")
    got = {r["site_id"]: r["geo_anomaly_rank"] for r in scoring.geo_anomaly(long, sites, 3).collect()}
    assert got["s0"] is None and len(got) == 6
    assert all(got[f"s{i}"] is not None for i in range(1, 6))
    two = scoring.geo_anomaly(long, sites.where("site_id in ('s1', 's2')"), 3)
    assert all(r["geo_anomaly_score"] is None for r in two.collect())


# --- neighbours --------------------------------------------------------------------------------


def brute_force(points, k, metric):
    ids = np.array([p[0] for p in points])
    out = {}
    for i, p in enumerate(points):
        d = np.array([metric(p, q) for q in points])
        order = np.lexsort((ids, d))
        out[p[0]] = [d[j] for j in order if j != i][:k]
    return out


def sphere(p, q):
    la, lb = math.radians(p[1]), math.radians(q[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
    return 2 * C.EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


@pytest.mark.parametrize("split", [10**9, 40])
def test_geographic_neighbours_equal_brute_force(spark, monkeypatch, split):
    """Scattered sites, a dense town, a third at one spot, the date line, a pole."""
    monkeypatch.setattr(neighbours, "SPLIT_ROWS", split)
    rng = np.random.default_rng(3)
    points = [(f"a{i}", float(rng.uniform(50, 55)), float(rng.uniform(-5, 1))) for i in range(60)]
    points += [(f"b{i}", 51.5 + float(rng.normal(0, 1e-3)), -0.1 + float(rng.normal(0, 1e-3))) for i in range(60)]
    points += [(f"c{i}", 52.0, 0.0) for i in range(70)]
    points += [(f"d{i}", 10.0 + i / 10, 179.95 if i % 2 else -179.95) for i in range(6)]
    points += [(f"e{i}", 89.9, i * 60.0 - 180) for i in range(6)]
    df = spark.createDataFrame(points, "site_id string, lat double, lon double").repartition(5)
    found = {}
    for r in neighbours.geographic_neighbours(df, 8).collect():
        found.setdefault(r["site_id"], []).append((r["rank"], r["distance_m"], r["peer_id"]))
    for site, want in brute_force(points, 8, sphere).items():
        got = sorted(found[site])
        assert [g[0] for g in got] == list(range(1, 9))
        assert [g[1] for g in got] == pytest.approx(want, abs=1e-3)
        assert site not in [g[2] for g in got]
    # Among equals the smallest ids win.
    assert [g[2] for g in sorted(found["c0"])] == sorted(f"c{i}" for i in range(1, 70))[:8]


def test_an_outlier_far_away_costs_no_pairs(spark, monkeypatch):
    """Levels follow the data: one point 10^9 spreads away leaves the rest as cheap as before."""
    rng = np.random.default_rng(8)
    points = [(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.random((3000, 2)))]
    schema = "site_id string, x double, y double"
    asked = []
    near = neighbours._Index.near

    def counted(self, queries):
        pairs = near(self, queries)
        asked.append((pairs.count(), self.levels))
        return pairs

    monkeypatch.setattr(neighbours._Index, "near", counted)
    alone = rows(neighbours.planar_neighbours(spark.createDataFrame(points, schema), 4), "site_id", "rank", "peer_id")
    far = spark.createDataFrame([*points, ("far", 1e9, -1e9)], schema)
    both = rows(neighbours.planar_neighbours(far, 4), "site_id", "rank", "peer_id")
    assert [r for r in both if r[0] != "far"] == alone
    assert max(n for n, _ in asked) < 3000 * 40
    assert len(asked[1][1]) <= len(asked[0][1]) + 3 and asked[1][1][-1] > 27


def test_nearest_targets_equal_brute_force_in_dense_towns(spark, monkeypatch):
    """Two tables: shared spots, a town of many targets and origins, the date line, a pole."""
    monkeypatch.setattr(neighbours, "SPLIT_ROWS", 100)
    rng = np.random.default_rng(13)

    def town(n):
        return np.column_stack([51.5 + rng.normal(0, 1e-3, n), -0.1 + rng.normal(0, 1e-3, n)])

    wide = np.column_stack([rng.uniform(-60, 60, 100), rng.uniform(-180, 180, 100)])
    there = np.concatenate([town(1500), wide, [[89.9, 0.0], [89.9, 180.0], [5.0, 179.99], [5.0, -179.99]], np.repeat([[52.0, 0.5]], 60, axis=0)])
    here = np.concatenate([town(1500), wide[:20] + 0.1, [[90.0, 0.0], [5.0, 180.0], [52.0, 0.5]], np.repeat([[52.0, 0.5]], 300, axis=0)])
    targets = [(f"t{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(there)] + [("bad", math.nan, 0.0)]
    origins = [(f"o{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(here)] + [("none", None, 1.0)]
    asked = []
    near = neighbours._Index.near
    monkeypatch.setattr(neighbours._Index, "near", lambda self, q: asked.append(near(self, q).count()) or near(self, q))
    found = neighbours.nearest_targets(
        spark.createDataFrame(origins, "site_id string, lat double, lon double").repartition(3),
        spark.createDataFrame(targets, "peer_id string, lat double, lon double").repartition(3),
        3,
    )
    got = {(r["site_id"], r["rank"]): (r["peer_id"], r["distance_m"]) for r in found.collect()}
    assert len(got) == 3 * len(here) and max(asked) < 40 * len(here)
    for i in [*range(0, 1500, 60), *range(1500, len(here), 7)]:
        want = sorted((sphere((0, here[i][0], here[i][1]), t), t[0]) for t in targets[:-1])[:3]
        mine = [got[f"o{i:04d}", n] for n in (1, 2, 3)]
        assert [d for _, d in mine] == pytest.approx([d for d, _ in want], abs=1e-3)
        if want[0][0] == want[2][0]:
            assert [p for p, _ in mine] == [p for _, p in want]
    empty = spark.createDataFrame([], "peer_id string, lat double, lon double")
    assert neighbours.nearest_targets(spark.createDataFrame(origins[:3], "site_id string, lat double, lon double"), empty, 3).count() == 0


def test_fewer_points_than_neighbours(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 9.0, 9.0)], "site_id string, x double, y double")
    assert neighbours.planar_neighbours(df, 10).count() == 6
    empty = df.where("x > 100")
    assert neighbours.planar_neighbours(empty, 3).count() == 0


def test_vector_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 25)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(0, 1, (120, 4)), rng.normal(20, 0.1, (60, 4)), np.ones((20, 4))])
    df = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(data)],
                               "site_id string, vector array<double>")
    found = {}
    for r in neighbours.vector_neighbours(df, 4).collect():
        found.setdefault(r["site_id"], []).append((r["rank"], r["distance"]))
    distances = np.linalg.norm(data[:, None] - data[None], axis=2)
    np.fill_diagonal(distances, np.inf)
    for i in range(len(data)):
        got = [d for _, d in sorted(found[f"v{i:03d}"])]
        assert got == pytest.approx(np.sort(distances[i])[:4].tolist(), abs=1e-9)


def test_peer_typology_ties_and_unknown(spark):
    sites = spark.createDataFrame([("f", "A"), ("g", None), ("1", "B"), ("2", "A"), ("3", "B"), ("4", "A"), ("5", None)],
                                  "site_id string, wfd_type string")
    edges = spark.createDataFrame(
        [("f", "1", 1), ("f", "2", 2), ("f", "3", 3), ("f", "4", 4), ("f", "5", 5)] + [("g", "5", 1)],
        "site_id string, peer_id string, rank int",
    )
    got = {r["site_id"]: r for r in peers.peer_typology(edges, sites).collect()}
    assert got["f"]["dominant_peer_type"] == "B" and got["f"]["peer_agreement_ratio"] == 0.4
    assert got["f"]["is_cross_type"] and got["f"]["peer_site_ids"] == ["1", "2", "3", "4", "5"]
    assert got["g"]["dominant_peer_type"] is None and not got["g"]["is_cross_type"]


# --- spatial ---------------------------------------------------------------------------------


def test_radius_join_equals_brute_force_on_hot_cells(spark, monkeypatch):
    rng = np.random.default_rng(11)
    sites = [(f"s{i}", float(rng.uniform(50, 50.2)), float(rng.uniform(0, 0.2))) for i in range(40)]
    sites.append(("far north", 69.99, 20.0))
    points = [(i, float(rng.uniform(50, 50.2)), float(rng.uniform(0, 0.2))) for i in range(200)]
    points += [(1000 + i, 50.1, 0.1) for i in range(100)] + [(5000, 70.0, 20.04)]
    left = spark.createDataFrame(sites, "site_id string, lat double, lon double")
    right = spark.createDataFrame(points, "point_id long, lat double, lon double")
    want = sorted((s[0], p[0]) for s in sites for p in points if sphere(s, p) <= 2000)
    assert rows(spatial.radius_join(left, right), "site_id", "point_id") == sorted(want, key=repr)
    original = skew.hot_keys
    monkeypatch.setattr(skew, "hot_keys", lambda df, keys, n: original(df, keys, 20))
    assert rows(spatial.radius_join(left, right), "site_id", "point_id") == sorted(want, key=repr)


def test_radius_join_over_the_date_line_and_the_pole(spark):
    sites = [("e", 10.0, 179.999), ("w", 10.0, -179.999), ("n", 89.995, 0.0), ("wide", 0.0, 180.0)]
    points = [(1, 10.0, -179.995), (2, 10.0, 179.99), (3, 89.995, 180.0), (4, 89.99, 90.0), (5, 0.001, -180.0), (6, 10.0, 0.0)]
    left = spark.createDataFrame(sites, "site_id string, lat double, lon double")
    right = spark.createDataFrame(points, "point_id long, lat double, lon double")
    for radius in (2000.0, 50_000.0, 9_000_000.0):
        want = sorted((s[0], p[0]) for s in sites for p in points if sphere(s, p) <= radius)
        assert rows(spatial.radius_join(left, right, radius), "site_id", "point_id") == sorted(want, key=repr)


def test_radius_join_measures_only_pairs_at_the_very_edge_before_it_returns_them(spark):
    """A radius equal to a distance keeps that pair; odd coordinates turn as they did."""
    rng = np.random.default_rng(13)
    sites = [(f"s{i}", float(rng.uniform(50, 50.05)), float(rng.uniform(0, 0.05))) for i in range(12)]
    sites += [("turned", 50.01, 360.02), ("same", 50.02, 0.02)]
    points = [(i, float(rng.uniform(50, 50.05)), float(rng.uniform(0, 0.05))) for i in range(30)] + [(99, 50.02, 0.02)]
    left = spark.createDataFrame(sites, "site_id string, lat double, lon double")
    right = spark.createDataFrame(points, "point_id long, lat double, lon double")
    plain = spatial.pair_distance(
        left.withColumnsRenamed({"lat": "lat1", "lon": "lon1"}).crossJoin(right.withColumnsRenamed({"lat": "lat2", "lon": "lon2"}))
    ).select("site_id", "point_id", "distance_m").collect()
    measured = sorted(r["distance_m"] for r in plain)
    for radius in (measured[40], float(np.nextafter(measured[40], 0)), 1e-4, 2000.0):
        want = sorted((tuple(r) for r in plain if r["distance_m"] <= radius), key=repr)
        assert rows(spatial.radius_join(left, right, radius), "site_id", "point_id", "distance_m") == want
    inside, reach = geo.squared_chords(2000.0)
    assert 0 < inside < reach < inside * 1.0001 and geo.squared_chords(1e-4)[0] == -1.0
    assert geo.squared_chords(3e7)[1] > 4.0
    plan = spatial.radius_join(left, right)._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.split("\n") if "Join Inner" in line and "ATAN2" in line)
    assert f"<= {str(reach)[:12]}" in condition.split("ATAN2")[0]


def test_radius_join_shares_pairs_among_all_tasks(spark):
    """Few bytes read may mean very many pairs, so the planner must not put them in one task."""
    grid = spark.range(4000).select(
        F.col("id").alias("point_id"), (50 + F.col("id") % 60 * 0.05).alias("lat"), (F.col("id") % 50 * 0.05).alias("lon")
    )
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = spatial.radius_join(grid.withColumnRenamed("point_id", "site_id"), grid)
        assert joined.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_rounded_equals_round(spark):
    rng = np.random.default_rng(14)
    values = [*rng.uniform(0, 2000, 3000), *(rng.integers(0, 4_000_000, 3000) / 2000), *rng.uniform(-1e9, 1e9, 500)]
    values += [0.0, -0.0, 0.0005, 0.0015, 1.0005, -1.0005, 1999.9995, 1e300, 5e-324, float("nan"), float("inf"), -float("inf")]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for digits in (0, 3, 6):
        got = df.select((F.round("v", digits) + F.lit(0.0)).alias("a"), (numeric.rounded(F.col("v"), digits) + F.lit(0.0)).alias("b"))
        assert got.where("NOT a <=> b").count() == 0


def test_radius_join_with_a_hundred_thousand_sites_at_one_spot(spark, monkeypatch):
    """Both sides of the crowded cell are split: no field of the grid holds more than its share."""
    monkeypatch.setattr(spatial, "ROWS_PER_SPLIT", 5000)
    spot = spark.range(100_000).select(F.concat(F.lit("s"), "id").alias("site_id"), F.lit(51.5).alias("lat"), F.lit(0.25).alias("lon"))
    points = spark.range(40).select(F.col("id").alias("point_id"), (51.5 + F.col("id") * 0.001).alias("lat"), F.lit(0.25).alias("lon"))
    near = [i for i in range(40) if sphere(("", 51.5, 0.25), ("", 51.5 + i * 0.001, 0.25)) <= 2000]
    got = spatial.radius_join(spot, points)
    assert got.count() == 100_000 * len(near)
    assert sorted(r[0] for r in got.select("point_id").distinct().collect()) == near
    visits = spot.select(F.lit(1).alias("c"), "site_id")
    tagged = visits.join(F.broadcast(skew.hot_keys(visits, ["c"], 5000)), "c").withColumn("part", skew._own_split("site_id", "_splits"))
    assert max(r["count"] for r in tagged.groupBy("part").count().collect()) < 2 * 5000


def _ring(*corners):
    return [(float(x), float(y)) for x, y in corners]


def _even_odd(rings, x, y):
    """Plain ray casting in rational numbers; None on an edge."""
    from fractions import Fraction as Q

    x, y, inside = Q(x), Q(y), False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            ax, ay, bx, by = Q(ax), Q(ay), Q(bx), Q(by)
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return None
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


@pytest.mark.parametrize("split", [10**9, 20])
def test_polygons_with_holes_and_parts_equal_ray_casting(spark, monkeypatch, split):
    """Stars over many cells, squares on cell borders, holes, islands, points on corners."""
    from sitewatch.operators import polygons as module

    monkeypatch.setattr(module, "ROWS_PER_SPLIT", split)
    rng = np.random.default_rng(21)

    def star(cx, cy, r, n):
        return [(cx + r * (1 + 0.4 * (i % 2)) * math.cos(2 * math.pi * i / n), cy + r * (1 + 0.4 * (i % 2)) * math.sin(2 * math.pi * i / n)) for i in range(n)]

    def square(x, y, w):
        return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]

    shapes = {
        "a": [[star(0.3, 0.2, 1.7, 41), star(0.3, 0.2, 0.9, 24)[::-1]], [star(0.3, 0.2, 0.4, 9)]],
        "b": [[square(-1.0, -1.0, 0.5), square(-0.875, -0.875, 0.25)[::-1]], [square(2.0, 2.0, 0.125)], [square(2.125, 2.0, 0.125)]],
        "c": [[[(-3.0, -3.0), (3.0, -2.99), (3.0, -2.5), (-3.0, -2.51)]]],
        "d": [[[(5.0, 5.0)]], [[]]],
        "e": [[square(0.25, 2.5, 0.03125)], [square(0.25, 2.5, 0.03125)]],  # twice: nothing is inside
    }
    points = rng.uniform(-3.2, 3.2, (900, 2)).tolist()
    points += [[i / 8, j / 8] for i in range(-9, 20) for j in range(-9, 20)]
    points += [[0.25 + float(x), 2.5 + float(y)] for x, y in rng.uniform(0, 0.03125, (40, 2))]
    sites = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)] + [(-1, None, 1.0)], "site_id int, lat double, lon double")
    kind = "water_body_id string, parts array<array<array<struct<x double, y double>>>>, name string"
    table = spark.createDataFrame([*[(k, v, "n" + k) for k, v in shapes.items()], ("a", shapes["a"], "na"), (None, shapes["c"], "x")], kind)
    table = table.dropDuplicates(["water_body_id"])
    for polygons in (table, table.union(table.limit(0))):
        got = {r["site_id"]: r["water_body_id"] for r in spatial.point_in_polygon_join(sites, polygons).collect()}
    assert len(got) == len(points) + 1 and got[-1] is None
    for i, (x, y) in enumerate(points):
        want = [k for k, parts in sorted(shapes.items()) if _even_odd([r for part in parts for r in part if r], x, y)]
        assert got[i] == (want[0] if want else None), (x, y)


def test_polygons_concave_ring_edges_and_fallback(spark):
    u_shape = _ring((0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3))
    polygons = spark.createDataFrame(
        [("W1", "River", "Good", None, "Moderate", u_shape), ("W2", "Lake", "Bad", "Fail", "Bad", _ring((5, 5), (6, 5), (6, 6)))],
        "water_body_id string, water_body_type string, ecological_class string, chemical_class string,"
        "overall_water_body_class string, ring array<struct<x:double,y:double>>",
    )
    rivers = spatial.rivers(polygons)
    sites = spark.createDataFrame(
        [("in", 0.5, 0.5), ("notch", 2.0, 1.5), ("edge", 0.0, 1.0), ("near", 1.5, 1.55), ("far", 9.0, 9.0)],
        "site_id string, lat double, lon double",
    )
    joined = spatial.point_in_polygon_join(sites, rivers)
    assert dict(rows(joined, "site_id", "water_body_id")) == {
        "in": "W1", "notch": None, "edge": None, "near": None, "far": None}
    centre = rivers.select(geo.ring_centroid(F.col("ring")).alias("c")).first()["c"]
    assert (centre["x"], centre["y"]) == pytest.approx((1.5, 9.5 / 7))
    filled = spatial.nearest_centroid_join(joined, rivers, 30_000.0)
    got = dict(rows(filled, "site_id", "by_centroid"))
    assert got == {"in": False, "notch": False, "edge": False, "near": True, "far": False}
    status = {r["site_id"]: r["wfd_status"] for r in spatial.clean_status(filled).collect()}
    assert status["near"]["ecological_status"] == "Good" and status["far"] is None


def test_grid_references(spark):
    df = spark.createDataFrame(
        [("SU 123 456",), ("tq12345678",), ("SU 12 3",), ("ZZ 12 34",), ("SU",), (None,), ("SU 12a4",), (" SU 1 2 ",)],
        "ref string",
    )
    got = [(r["easting"], r["northing"]) for r in pressures.georeference_grid(df, "ref").collect()]
    none = (None, None)
    assert got == [(412300.0, 145600.0), (512340.0, 156780.0), none, none, none, none, none, (410000.0, 120000.0)]


def test_projection_known_point(spark):
    # Worked example of the published national grid guide: N 52 39 27.2531, E 1 43 4.5177.
    df = spark.createDataFrame([(651409.903, 313177.270)], "easting double, northing double")
    got = pressures.easting_northing_to_latlon(df).first()
    assert got["lat"] == pytest.approx(52 + 39 / 60 + 27.2531 / 3600, abs=1e-8)
    assert got["lon"] == pytest.approx(1 + 43 / 60 + 4.5177 / 3600, abs=1e-7)


def test_overflow_tables_without_ids(spark):
    df = spark.createDataFrame(
        [("p", "g", 2020, "5"), ("p", "g", 2020, "9"), ("p", "g", 2021, "n/a"), ("q", "g", 2020, None)],
        "permit_ref string, outlet_ngr string, reporting_year int, spill_count string",
    )
    got = rows(pressures.dedupe_overflows(df), "permit_ref", "reporting_year", "spill_count")
    assert got == [("p", 2020, 9.0), ("p", 2021, None), ("q", 2020, None)]


def test_pressure_structs(spark):
    summary = spark.createDataFrame(
        [("a", 1, "2020-01-01", "x", 0, None, None, True, 1), ("b", 0, None, None, 0, 0.0, None, False, 0)],
        "site_id string, total_pollution_incidents int, most_recent_pollution_date string, primary_pollution_cause string,"
        "total_edm_spills int, total_spill_hours double, most_recent_spill_date string, has_any_incidents boolean, total_all_incidents int",
    )
    sites = spark.createDataFrame([("a",), ("b",), ("c",)], "site_id string")
    got = {r["site_id"]: r["incidents"] for r in pressures.merge_incidents(sites, summary).collect()}
    assert got["a"]["total_spill_hours"] == 0.0 and got["b"] is None and got["c"] is None


# --- text ------------------------------------------------------------------------------------


def test_display_names_follow_python_title(spark):
    names = ["RIVER THAMES AT THE weir", "st john's A2-B of x", "2nd bridge", "", None, "été IN été"]
    df = spark.createDataFrame([(n, f"id{i}") for i, n in enumerate(names)], "site_label string, site_id string")

    def expected(name, site_id):
        out = (name or site_id).title()
        for w in C.DISPLAY_SMALL_WORDS:
            out = out.replace(f" {w} ", f" {w.lower()} ")
        return out

    got = [r["display_name"] for r in narrative.with_display_name(df).collect()]
    assert got == [expected(n, f"id{i}") for i, n in enumerate(names)]


def test_public_titles_and_labels(spark):
    df = spark.createDataFrame([("THE BRIDGE-BY the/SEA 12b",), ("",), (None,)], "site_label string")
    got = [r["site_title"] for r in narrative.with_title_case(df).collect()]
    assert got == ["The Bridge-by the/Sea 12b", "Unnamed monitoring site", "Unnamed monitoring site"]
    labels = spark.createDataFrame([("Nitrate as N",), ("pH",), ("Oxygen, Dissolved, % Saturation",), ("zinc",)], "n string")
    got = [r[0] for r in labels.select(text.public_chemical_label(F.col("n"))).collect()]
    assert got == ["Nitrate as N", "pH", "Oxygen saturation", "Zinc"]


def _scored(spark, **over):
    base = dict(site_id="s", site_label="MILL AT bourne", anomaly_rank=1, anomaly_score=3.0, is_flagged=True,
                is_cross_type=False, anomaly_drivers="111|Zinc", top_anomaly_driver="Zinc", score_peer_group_size=1234,
                wfd_type="Low, Small", wfd_type_resolved=None, score_reference="global", region="R", water_body_name="W")
    base.update(over)
    return spark.createDataFrame([base], ", ".join(
        f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'string'}"
        for k, v in base.items()))


def _z(spark):
    return spark.createDataFrame([("s", "Ammoniacal Nitrogen as N", 3.14159), ("s", "Zinc", -2.5)],
                                 "site_id string, feature string, z double")


@pytest.mark.parametrize("rank, start", [
    (1, "Mill at Bourne ranks #1 nationally. The main signals are elevated ammonia-related nitrogen"),
    (2, "Elevated ammonia-related nitrogen stands out at Mill at Bourne, which ranks #2 nationally for unusual chemistry. The main signal is low Zinc."),
    (3, "Among 1,234 similar Low, Small rivers, Mill at Bourne is one of the most chemically unusual (ranked #3 nationally)."),
    (4, "On the W in R, Mill at Bourne shows chemistry that stands out from comparable rivers."),
])
def test_narratives_by_rank(spark, rank, start):
    told = narrative.narrate(narrative.driver_details(_scored(spark, anomaly_rank=rank), _z(spark))).first()
    assert told["summary"].startswith(start)
    assert [d["direction"] for d in told["drivers"]] == ["high", "low"]
    assert told["drivers"][0]["z"] == 3.142


def test_narratives_without_drivers_or_flags(spark):
    plain = _scored(spark, anomaly_drivers="", top_anomaly_driver="")
    assert narrative.narrate(narrative.driver_details(plain, _z(spark))).first()["summary"] == C.NO_DRIVER_SUMMARY
    quiet = _scored(spark, is_flagged=False)
    told = narrative.narrate(narrative.driver_details(quiet, _z(spark))).first()
    assert told["summary"] == C.NORMAL_SUMMARY and told["drivers"] == []
    unknown = narrative.driver_details(_scored(spark, anomaly_drivers="", top_anomaly_driver="Lead"), _z(spark)).first()
    assert unknown["drivers"][0]["direction"] == "unknown" and unknown["drivers"][0]["description"] == "unusual Lead"


def test_phosphate_counts_as_ph_after_nutrients(spark):
    df = spark.createDataFrame(
        [([("Orthophosphate, reactive as P", "high")],), ([("Orthophosphate, reactive as P", "low")],), ([("Zinc", "high")],)],
        "drivers array<struct<name:string,direction:string>>",
    )
    assert [r[0] for r in df.select(narrative.headline_class(F.col("drivers"))).collect()] == ["nutrients", "ph", "other"]


def test_site_brief_is_json(spark):
    df = narrative.narrate(narrative.driver_details(_scored(spark), _z(spark)))
    df = narrative.with_display_name(df).select(
        "*", F.lit(0.5).alias("peer_agreement_ratio"), F.lit("well").alias("confidence_tier"),
        F.struct(F.lit(None).cast("string").alias("overall_status"), F.lit("Good").alias("ecological_status"),
                 F.lit("").alias("chemical_status")).alias("wfd_status"))
    brief = json.loads(narrative.site_brief(df).first()["brief"])
    assert brief["cross_typology_match"] == "3 out of 5"
    assert brief["wfd_status"] == {"ecological": "Good", "chemical": "Not available", "overall": "Not available"}
    assert brief["regulated_discharge_points"] == {"sewage_works": 0, "storm_overflows": 0, "industrial": 0}


# --- feed and gates --------------------------------------------------------------------------


def test_union_by_name_relaxes_types(spark):
    a = spark.createDataFrame([(1, "x")], "id int, only_a string")
    b = spark.createDataFrame([("k", 2.5)], "id string, only_b double")
    got = feed.union_by_name(a, b)
    assert dict(got.dtypes)["id"] == "string" and got.count() == 2 and set(got.columns) == {"id", "only_a", "only_b"}


def test_gates_on_tiny_tables(spark):
    one = spark.createDataFrame([("s", 1)], "site_id string, anomaly_rank int")
    assert gates.gate_rank_stability(one, None).first()["passed"]
    assert gates.gate_rank_stability(one, one).first()["passed"]
    assert gates.gate_rank_continuity(one).first()["passed"]
    twice = one.union(one)
    assert not gates.gate_rank_continuity(twice).first()["passed"]
    skewed = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (9.0,)], "anomaly_score double")
    assert "1.914" in gates.gate_score_skew(skewed).first()["message"]
    prefixes = spark.createDataFrame([("AN-1",), ("NW-2",), (None,)], "site_id string")
    assert gates.gate_regions(prefixes, GateSettings(min_regions=2)).first()["passed"]
    assert not gates.gate_null_rates(prefixes).first()["passed"]
    with pytest.raises(gates.GateFailed):
        gates.run_gates(gates.gate_rank_continuity(twice))


# --- repairs: long texts, many drivers, infinite and missing numbers, moved sites -----------


def test_long_tokens_and_many_drivers_stay_whole(spark):
    from pyspark.sql import functions as F

    from sitewatch.functions.text import title_every_word

    token = "x" * 1_200_000
    row = spark.createDataFrame([(token,)], "t string").select(title_every_word(F.col("t")).alias("t")).first()
    assert row["t"] == "X" + token[1:]
    many = spark.range(1).select(F.slice(F.sequence(F.lit(1), F.lit(1200)), F.lit(2), F.lit(1200)).alias("s")).first()
    assert len(many["s"]) == 1199


def test_infinite_measurements_are_null_and_bins_are_total(spark):
    from pyspark.sql import functions as F

    from sitewatch.functions.numeric import order_bin
    from sitewatch.operators.cleaning import parse_censored

    raw = spark.createDataFrame([("1e999", "a"), ("-1e999", "a"), ("<3", "a"), ("2.5", "a")], "result_raw string, determinant string")
    assert [r["value"] for r in parse_censored(raw).collect()][:2] == [None, None]
    values = [float("-inf"), -1e300, -1.0, 0.0, 1e-300, 7.0, float("inf")]
    bins = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(order_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins) and len(set(bins)) == len(bins)


def test_sample_times_do_not_depend_on_the_time_zone(spark):
    from sitewatch.operators.cleaning import parse_sample_time

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        df = spark.createDataFrame([("2024-03-31T01:30:00",), ("no time",)], "sample_datetime string")
        found = [r["sample_dt"] for r in parse_sample_time(df).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert str(found[0]) == "2024-03-31 01:30:00" and found[1] is None


def test_a_moved_site_keeps_a_place_where_it_has_been(spark):
    from sitewatch.operators.statistics import site_metadata

    rows = [("s", 51.0, 0.5, 2), ("s", 50.0, 1.0, 3), ("s", None, 0.1, 1)]
    df = spark.createDataFrame(rows, "site_id string, lat double, lon double, t int")
    first = site_metadata(df, ("t",)).first()
    assert (first["lat"], first["lon"]) == (51.0, 0.5)


@pytest.mark.parametrize("tile, block", [(4, 3), (2000, 20000)])
def test_vector_neighbours_with_small_far_clusters_and_bad_components(spark, monkeypatch, tile, block):
    import numpy as np

    from sitewatch.operators import neighbours

    monkeypatch.setattr(neighbours, "TILE_ROWS", tile)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(size=(40, 3)), rng.normal(size=(6, 3)) + 1000])
    rows = [(f"s{i:02d}", [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [("nan", [float("nan"), 0.0, 0.0]), ("null", [None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "site_id string, vector array<double>")
    got = {(r["site_id"], r["rank"]): r["peer_id"] for r in neighbours.vector_neighbours(df, 3).collect()}
    for i, v in enumerate(data):
        d = np.sqrt(((data - v) ** 2).sum(axis=1))
        near = [j for j in np.lexsort((np.arange(len(d)), d)) if j != i][:3]
        assert [got[f"s{i:02d}", r + 1] for r in range(3)] == [f"s{j:02d}" for j in near]
    assert not any(s in ("nan", "null") for s, _ in got)


def test_intermediate_folder_is_shared_or_refused(spark, monkeypatch):
    from types import SimpleNamespace

    from sitewatch.operators import checkpoints

    def session(settings, master, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default))
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
        return SimpleNamespace(conf=conf, sparkContext=context)

    local = {checkpoints.WAREHOUSE: "file:/tmp/warehouse"}
    assert checkpoints.checkpoint_root(session(local, "local[8]")) == "file:/tmp/warehouse/_intermediate"
    assert checkpoints.checkpoint_root(session(local | {checkpoints.SETTING: "hdfs://n/c/"}, "yarn")) == "hdfs://n/c"
    assert checkpoints.checkpoint_root(session({checkpoints.WAREHOUSE: "s3a://b/w"}, "yarn")) == "s3a://b/w/_intermediate"
    with pytest.raises(RuntimeError, match="all executors share"):
        checkpoints.checkpoint_root(session(local, "spark://host:7077"))


# --- work that grows with the input ----------------------------------------------------------


def test_statistics_of_small_and_large_groups_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = [(f"s{i % 7}", None if i % 5 == 0 else "0001", None if i % 3 == 0 else "mg/l", "b" if i % 11 else "a",
             None if i % 13 == 0 else float("nan") if i % 17 == 0 else float(np.round(rng.normal(), 1)), 2000 + i % 40) for i in range(900)]
    df = spark.createDataFrame(data, "site_id string, determinand_code string, unit string, determinant string, value double, year int")
    df = df.withColumn("sample_dt", F.make_timestamp_ntz("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    table = lambda: sorted(repr([round(v, 9) + 0.0 if isinstance(v, float) else v for v in r]) for r in statistics.site_determinand_stats(df).collect())
    small = table()
    for limit in (0, 15):  # all groups by radix selection, then both ways side by side
        monkeypatch.setattr(statistics, "SORTED_ROWS", limit)
        assert table() == small


def test_statistics_of_small_groups_need_one_exchange(spark):
    df = spark.range(400).select(
        (F.col("id") % 90).cast("string").alias("site_id"), F.lit("1").alias("determinand_code"), F.lit("mg/l").alias("unit"),
        F.lit("pH").alias("determinant"), F.col("id").cast("double").alias("value"), F.lit(2020).alias("year"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("sample_dt"),
    )
    plan = statistics.site_determinand_stats(df)._jdf.queryExecution().sparkPlan().toString()
    executed = statistics.site_determinand_stats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and executed.count("Exchange hashpartitioning") == 1


def test_vector_neighbours_send_a_row_once_to_pivots_that_lie_together(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "site_id string, vector array<double>")
    monkeypatch.setattr(neighbours, "TILE_ROWS", 15)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    far = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2))
    want = {(f"v{i:03d}", r + 1): f"v{j:03d}" for i in range(300) for r, j in enumerate([j for j in np.argsort(far[i], kind="stable") if j != i][:3])}
    for pack in (8, 70):  # crowded pivots in several packs, several pivots in a pack
        monkeypatch.setattr(neighbours, "PACK_ROWS", pack)
        assert {(r["site_id"], r["rank"]): r["peer_id"] for r in neighbours.vector_neighbours(df, 3).collect()} == want
    pivots, held = vectors[:20], np.full(20, 15)
    first, parts = neighbours._packs(pivots, held)
    assert set(parts) == {1} and len(set(first)) == 5  # 20 tiles before


def test_totals_around_sites_equal_those_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    spot = lambda: (float(50 + rng.integers(0, 6) * 0.01), float(rng.integers(0, 6) * 0.01))
    sites = [(None if i % 17 == 0 else f"s{i % 40}", *spot()) for i in range(60)] + [("lost", None, 0.0), ("far", 60.0, 0.0)]
    points = [(f"p{i}", [None, "sewage_works", "storm_overflow", "industrial", "other"][i % 5], [None, "", "x", "y"][i % 4],
               None if i % 9 == 0 else float(i % 6), float("nan") if i % 7 == 0 else i / 8, 2000 + i % 9, *spot()) for i in range(120)]
    left = spark.createDataFrame(sites, "site_id string, lat double, lon double")
    right = spark.createDataFrame(
        points, "point_id string, discharge_category string, discharge_site_name string, spill_count double, duration_hours double, reporting_year int, lat double, lon double"
    ).withColumn("pollutant_type", F.col("discharge_category")).withColumn("incident_date", F.make_date("reporting_year", F.lit(1), F.lit(2)))
    paired, original = [], spatial.radius_join

    def watched(*args):
        paired.append(original(*args).count())
        return original(*args)

    pairs = original(left, right, 1500.0).cache()
    monkeypatch.setattr(spatial, "radius_join", watched)
    for gather, summary in (
        (pressures.incidents_around, pressures.incident_summary),
        (pressures.overflows_around, pressures.overflow_summary),
        (pressures.permits_around, pressures.discharge_summary),
    ):
        got = sorted(map(repr, summary(left, gather(left, right, 1500.0)).collect()))
        assert got == sorted(map(repr, summary(left, pairs).collect()))
    places = {p[-2:] for p in points}
    assert max(paired) < pairs.count() and paired[1] <= 36 * len(places)


def test_a_grid_reference_is_read_once_a_row(spark):
    df = spark.createDataFrame([("SU 123 456",), ("zz",), (None,)], "ref string")
    found = pressures.georeference_grid(df, "ref").where("easting IS NOT NULL")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") + plan.count("rlike") == 1
    assert found.count() == 1 and found.columns == ["ref", "easting", "northing"]
