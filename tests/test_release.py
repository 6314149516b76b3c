"""Files in and out, and a whole release over written layers."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sitewatch.config import FeatureSettings, GateSettings, PeerSettings, Settings
from sitewatch.operators import gates
from sitewatch.operators.checkpoints import checkpoint_root, cut
from sitewatch.plans import release
from sitewatch.sources import layers
from sitewatch.plans.pressures import Pressures
from sitewatch.sources.feed import published, read_feed, read_feed_lines, write_feed
from sitewatch.sources.observations import NoInput, lookup_candidates, read_lookup, read_observations
from sitewatch.sources.overflow_returns import harmonise_overflow_returns

HEADER = (
    "samplingPoint.notation,samplingPoint.prefLabel,samplingPoint.region,samplingPoint.latitude,"
    "samplingPoint.longitude,phenomenonTime,sampleMaterialType,determinand.notation,determinand.prefLabel,unit,result"
)
PANEL = {"61": "pH", "117": "Nitrate as N", "111": "Ammoniacal Nitrogen as N"}


def _write_raw(folder):
    lines = {2019: [], 2020: [], 2014: []}
    for site in range(24):
        for year in lines:
            for code, name in PANEL.items():
                for month in (1, 4, 7):
                    value = 7 + site % 5 / 10 + month / 100 + (50 if site == 3 and code == "111" else 0)
                    text = f"<{value}" if site % 6 == 0 else str(value)
                    lines[year].append(
                        f"R{site % 3}-{site},MILL AT site {site},Region {site % 3},{51 + site / 50},{-1 + site % 7 / 20},"
                        f"{year}-0{month}-05T10:00:00,RIVER / RUNNING SURFACE WATER,00{code},{name},mg/l,{text}"
                    )
    for year, body in lines.items():
        (folder / f"obs_area-9_{year}.csv").write_text("\n".join([HEADER, *body]) + "\n")


def test_read_observations(spark, tmp_path):
    with pytest.raises(NoInput):
        read_observations(spark, str(tmp_path))
    _write_raw(tmp_path)
    spark.createDataFrame([("X", 5.0)], "site_id string, extra double").write.parquet(str(tmp_path / "more.parquet"))
    raw = read_observations(spark, str(tmp_path))
    by_year = {r["source_year"]: r["n"] for r in raw.groupBy("source_year").agg(F.count("*").alias("n")).collect()}
    assert by_year == {2019: 216, 2020: 216, None: 1}
    assert raw.where("extra IS NULL").first()["determinand.notation"].startswith("00")


def test_lookup_snapshot_and_returns(spark, tmp_path):
    places = lookup_candidates(str(tmp_path / "processed"), str(tmp_path))
    assert read_lookup(spark, places) is None
    (tmp_path / "site_wfd_typology_lookup.csv").write_text("site_id,wfd_type\na,T1\n")
    assert read_lookup(spark, places).first()["wfd_type"] == "T1"

    archive, df = str(tmp_path / "archive"), spark.range(3)
    assert layers.latest_snapshot(spark, archive, "x") is None
    for run, n in (("20260101", 3), ("20260301", 2), ("20260201", 1)):
        layers.snapshot_run(spark.range(n), archive, "x", run)
    newest = layers.latest_snapshot(spark, archive, "x")
    assert newest.count() == 2 and newest.first()["run_id"] == "20260301"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        layers.snapshot_run(df, archive, "x", "20260101")
    with pytest.raises(ValueError, match="outlet"):
        harmonise_overflow_returns([(df, 2020, "a")])


def test_feed_documents(spark, tmp_path):
    record = {"site_id": "a", "lat": 1.5, "lon": 2.5, "drivers": []}
    (tmp_path / "list.json").write_text(json.dumps([record]))
    (tmp_path / "object.json").write_text(json.dumps({"total": 1, "feed": [record]}))
    for name in ("list.json", "object.json"):
        assert tuple(read_feed(spark, str(tmp_path / name)).first()) == ("a", 1.5, 2.5)
    assert not gates.gate_readable(spark, str(tmp_path / "absent")).first()["passed"]
    (tmp_path / "broken" / "feed").mkdir(parents=True)
    (tmp_path / "broken" / "feed" / "part.json").write_text('{"site_id": "a"}\n{"site_id": \n')
    assert not gates.gate_readable(spark, str(tmp_path / "broken")).first()["passed"]


def test_cut_writes_below_the_checkpoint_folder(spark):
    root = checkpoint_root(spark)
    assert root == checkpoint_root(spark)
    table = cut(spark.range(5), "numbers")
    assert table.count() == 5
    assert all(root.split(":")[-1].lstrip("/") in f for f in table.inputFiles())


def test_named_checkpoint_folder_is_used():
    class Conf:
        def get(self, key, default):
            return "hdfs:///shared" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert checkpoint_root(Session()) == "hdfs:///shared"


def test_release_end_to_end(spark, tmp_path):
    raw, root, archive = tmp_path / "raw", str(tmp_path / "root"), str(tmp_path / "archive")
    raw.mkdir()
    _write_raw(raw)
    settings = Settings(
        features=FeatureSettings(panel=PANEL),
        peers=PeerSettings(shortlist_k=8, final_k=3, broad_k=6),
        gates=replace(GateSettings(), first_run_rows=100, size_mb_range=(0.0, 1.0)),
    )
    lookup = spark.createDataFrame([(f"R{i % 3}-{i}", f"Type {i % 2}") for i in range(20)], "site_id string, wfd_type string")
    feed = release.run_release(
        spark, str(raw), root, archive, "run1", 2021, lookup, settings, halt=False
    )
    records = {r["site_id"]: r for r in feed.collect()}
    assert len(records) == 24
    top = min(records.values(), key=lambda r: r["anomaly_rank"])
    assert top["site_id"] == "R0-3" and top["is_flagged"] and top["drivers"][0]["name"] == "Ammoniacal Nitrogen as N"
    assert "Mill at Site 3" in top["summary"]
    assert records["R2-23"]["wfd_type"] is None and len(records["R2-23"]["peer_site_ids"]) == 3
    assert read_feed(spark, f"{root}/published").count() == 24
    header = spark.read.json(f"{published(spark, f'{root}/published')}/header").first()
    assert header["total_sites"] == 24 and header["data_period_start"] == "2019-01-05"
    report = {r["check"]: r["passed"] for r in spark.read.json(f"{root}/reports/gate_3").collect()}
    assert report["schema"] and report["readable"] and report["narratives"]

    again = release.run_release(
        spark, str(raw), root, archive, "run2", 2021, lookup, settings, first_layer=4, halt=False
    )
    assert again.count() == 24
    feed = again  # the first feed's files were replaced by the second run
    assert layers.latest_snapshot(spark, archive, "feed").first()["run_id"] == "run2"
    with pytest.raises(gates.GateFailed):
        gates.run_gates(gates.gate_1(release.read_layer(spark, root, "observations"), 2021, None, settings.gates))

    sites = feed.select("site_id", "lat", "lon")
    near = sites.where("site_id = 'R0-3'").select(F.lit(1).alias("incident_id"), F.lit("2020-01-01").cast("date").alias("incident_date"),
                                                  F.lit("Oil").alias("pollutant_type"), "lat", "lon")
    near = cut(near, "near")  # the feed's files are replaced by the next run
    spills = near.select(F.lit("o").alias("point_id"), F.lit(2020).alias("reporting_year"), F.lit(4.0).alias("spill_count"),
                         F.lit(2.5).alias("duration_hours"), "lat", "lon")
    permits = near.select(F.lit("d").alias("point_id"), F.lit("industrial").alias("discharge_category"),
                          F.lit("").alias("discharge_site_name"), "lat", "lon")
    ring = [(-2.0, 50.0), (0.0, 50.0), (0.0, 51.2), (-2.0, 51.2)]
    polygons = spark.createDataFrame(
        [("W", "Brook", "River", "Moderate", "Poor", "Fail", ring)],
        "water_body_id string, water_body_name string, water_body_type string, overall_water_body_class string,"
        "ecological_class string, chemical_class string, ring array<struct<x:double,y:double>>",
    )
    last = release.run_release(
        spark, str(raw), root, archive, "run3", 2021, lookup, settings, first_layer=4, halt=False,
        tables=Pressures(near, spills, permits, polygons),
    )
    rich = {r["site_id"]: r for r in last.collect()}
    assert rich["R0-3"]["incidents"]["total_all_incidents"] == 2
    assert rich["R0-3"]["wfd_status"]["ecological_status"] == "Poor"
    assert rich["R0-3"]["discharge_points"]["nearest_industrial"]["name"] == "Unknown"
    assert rich["R2-23"]["incidents"] is None and rich["R2-23"]["discharge_points"] is None
    # What is published and archived is the enriched feed, of all sites.
    lines = spark.read.json(f"{published(spark, f'{root}/published')}/feed").where("site_id = 'R0-3'").first()
    assert lines["incidents"]["total_all_incidents"] == 2 and lines["wfd_status"]["ecological_status"] == "Poor"
    kept = layers.latest_snapshot(spark, archive, "feed")
    assert kept.count() == 24 and kept.where("incidents IS NOT NULL").count() == 1
    report = {r["check"]: r["passed"] for r in spark.read.json(f"{root}/reports/gate_3").collect()}
    assert report["readable"] and report["schema"]


def test_measures_of_a_passed_gate_are_archived_and_compared_with(spark, tmp_path):
    raw, root, archive = tmp_path / "raw", str(tmp_path / "root"), str(tmp_path / "archive")
    raw.mkdir()
    _write_raw(raw)
    passing = replace(
        GateSettings(), first_run_rows=100, min_site_count=10, min_years=2, min_regions=2, max_null_rate=1.0,
        value_ranges={"pH": (0.0, 100.0)},
    )
    obs = release.ingest(spark, str(raw), root)
    measured = gates.measure_observations(obs, ("0061", "00117"), passing)
    row = measured.first()
    assert row["row_count"] == 432 and row["site_count"] == 24 and row["missing_codes"] == []
    assert row["regions"] == ["Region 0", "Region 1", "Region 2"] and row["n_years"] == 2
    checks = gates.checks_of_observations(measured, obs.columns, 2021, None, passing)
    assert all(r["passed"] for r in gates.run_gates(checks, halt=False))
    layers.snapshot_run(gates.gate_metadata(measured), archive, release.MEASURES, "r1")
    before = layers.latest_snapshot(spark, archive, release.MEASURES).first()
    assert before["determinand_codes"] == ["00111", "00117", "0061"] and str(before["date_min"])[:10] == "2019-01-05"
    fewer = gates.measure_observations(obs.where("site_id <> 'R0-3'").limit(300), ("0061",), passing)
    failed = {r["check"] for r in gates.checks_of_observations(fewer, obs.columns, 2021, before["row_count"], passing).collect() if not r["passed"]}
    assert failed == {"row_count"}
    # Single gates and the one pass agree, also on missing columns and on no rows.
    for table in (obs, obs.drop("region", "value"), obs.where("false")):
        one = {r["check"]: (r["passed"], r["message"], r["details"]) for r in gates.gate_1(table, 2021, 400, passing).collect()}
        single = gates._union(
            gates.gate_row_count(table, 400, passing), gates.gate_site_count(table, passing), gates.gate_determinands(table),
            gates.gate_value_ranges(table, passing), gates.gate_null_rates(table, passing),
            gates.gate_temporal(table, 2021, passing), gates.gate_regions(table, passing),
        )
        for r in single.collect():
            assert one[r["check"]][:2] == (r["passed"], r["message"])
            if r["details"] is not None:
                assert json.loads(one[r["check"]][2]) == json.loads(r["details"])


def test_gate_1_scans_once(spark):
    obs = spark.range(10).select(F.col("id").cast("string").alias("site_id"), F.lit("1").alias("determinand_code"),
                                 F.lit("pH").alias("determinant"), F.lit(7.0).alias("value"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"),
                                 F.current_timestamp().cast("timestamp_ntz").alias("sample_dt"))
    plans = []
    original = gates.cut
    try:
        gates.cut = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or original(df, name)
        gates.measure_observations(obs)
    finally:
        gates.cut = original
    assert plans[0].count("Range (") == 1


def test_versions_change_at_one_moment(spark, tmp_path):
    path = str(tmp_path / "published")
    table = spark.createDataFrame([("a", 1.0, 2.0, 1), ("b", 1.0, 2.0, 2)], "site_id string, lat double, lon double, anomaly_rank int")
    header = table.agg(F.count("*").alias("n"))
    first = write_feed(table, header, path)
    second = layers.new_version(path)
    table.limit(1).write.json(f"{second}/feed")  # half written: nobody sees it
    assert layers.current_version(spark, path) == first and read_feed(spark, path).count() == 2
    layers.publish_version(spark, path, second)
    assert layers.current_version(spark, path) == second and read_feed(spark, path).count() == 1
    assert layers.current_version(spark, str(tmp_path / "none")) is None
    assert layers.current_version(spark, f"file://{path}").endswith(second.rsplit("/", 1)[-1])


def test_damaged_lines_are_numbered_over_parts_of_files(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    lines = [json.dumps({"site_id": f"s{i}", "lat": 1.0}) for i in range(500)]
    for at in (0, 7, 250, 499):
        lines[at] = lines[at][:-3]
    lines[100], lines[101] = "", json.dumps({"lat": 2})
    (folder / "a.json").write_text("\n".join(lines) + "\n")
    (folder / "b.json").write_text("\n".join(lines[:9]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert read_feed_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 1
        bad = read_feed_lines(spark, str(tmp_path)).where("not readable").collect()
        check = gates.gate_readable(spark, str(tmp_path)).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [("a.json", n) for n in (1, 8, 102, 251, 500)] + [("b.json", n) for n in (1, 8)]
    assert sorted((r["file"], r["line"]) for r in bad) == want
    told = json.loads(check["details"])
    assert not check["passed"] and told["entries"] == 508 and told["unreadable"] == 7
    assert [(x["file"], x["line"]) for x in told["lines"]] == want
