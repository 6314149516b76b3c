"""Reading and writing: what is written from the tables is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitewatch.catalog.base import sql
from sitewatch.fixtures import view
from sitewatch.operators.checkpoints import checkpoint_root
from sitewatch.sources import feed, layers, observations

_TEXTS = ["site_id", "determinand_code", "determinant", "unit", "sample_material", "result_raw"]


def _folder(spark) -> str:
    return f"{checkpoint_root(spark)}/sitewatch/files-{uuid.uuid4().hex}"


def read_observations(spark, sf):
    """Half of the raw rows as CSV files and half as parquet files of one folder."""
    raw = view(spark, sf, "fx_obs_raw").select(*_TEXTS)
    as_text = F.pmod(F.hash("site_id"), F.lit(2)) == 0
    folder = _folder(spark)
    raw.where(as_text).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    raw.where(~as_text).write.mode("append").parquet(folder)
    return observations.read_observations(spark, folder).select(*_TEXTS)


def read_lookup(spark, sf):
    """The first candidate does not exist, the second one is a CSV file."""
    folder = _folder(spark)
    types = view(spark, sf, "fx_vectors").select("site_id", "wfd_type")
    types.write.option("header", True).csv(f"{folder}/site_wfd_typology_lookup.csv")
    return observations.read_lookup(spark, observations.lookup_candidates(f"{folder}/none", folder))


def write_layer(spark, sf):
    """A layer in folders by unit."""
    root = _folder(spark)
    layers.write_layer(view(spark, sf, "fx_obs_raw").select(*_TEXTS), root, "raw", ("unit",))
    return layers.read_layer(spark, root, "raw").select(*_TEXTS)


def _places(spark, sf):
    return view(spark, sf, "fx_sites").select("site_id", "lat", "lon")


def read_feed(spark, sf):
    """A feed with its header, written as lines and read back."""
    folder = _folder(spark)
    places = _places(spark, sf).withColumn("anomaly_rank", F.abs(F.hash("site_id")))
    feed.write_feed(places, places.agg(F.count(F.lit(1)).alias("sites")), folder)
    return feed.read_feed(spark, folder)


def latest_snapshot(spark, sf):
    """Two archived runs of all sites, told apart by a column of theirs."""
    archive, places = _folder(spark), _places(spark, sf)
    layers.snapshot_run(places.withColumn("release", F.lit(2)), archive, "places", "20260102_000000")
    layers.snapshot_run(places.withColumn("release", F.lit(1)), archive, "places", "20260101_000000")
    return layers.latest_snapshot(spark, archive, "places")


def write_feed(spark, sf):
    """Two versions of a feed published one after the other; readers see the second."""
    folder = _folder(spark)
    places = _places(spark, sf).withColumn("anomaly_rank", F.abs(F.hash("site_id")))
    header = places.agg(F.count(F.lit(1)).alias("sites"))
    feed.write_feed(places.where("lat > 52"), header, folder)
    feed.write_feed(places.withColumn("lon", F.col("lon") + 1), header, folder)
    return feed.read_feed(spark, folder)


QUERIES = {
    "read_observations": read_observations,
    "read_lookup": read_lookup,
    "write_layer": write_layer,
    "read_feed": read_feed,
    "write_feed": write_feed,
    "latest_snapshot": latest_snapshot,
}
_RAW = f"SELECT {', '.join(_TEXTS)} FROM fx_obs_raw"
ORACLES = {
    "read_observations": sql(_RAW),
    "read_lookup": sql("SELECT site_id, wfd_type FROM fx_vectors"),
    "write_layer": sql(_RAW),
    "read_feed": sql("SELECT site_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM fx_sites"),
    "write_feed": sql("SELECT site_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) + 1 AS lon FROM fx_sites"),
    "latest_snapshot": sql("SELECT site_id, lat, lon, 2 AS release, '20260102_000000' AS run_id FROM fx_sites"),
}
