"""Scoring, ranking and neighbour queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sitewatch.catalog.base import imputed, layer, r, sql
from sitewatch.config import PeerSettings, ScoringSettings
from sitewatch.fixtures import view
from sitewatch.operators import neighbours, peers, scoring

PEERS = PeerSettings(shortlist_k=20, final_k=5, broad_k=20)
GEO_K = 20
DRIVER_Z = 1.5


def scored_inputs(spark, sf):
    """Imputed values and the sites they belong to."""
    long = imputed(spark, sf)
    ids = long.select("site_id").distinct()
    sites = view(spark, sf, "fx_sites").join(ids, "site_id", "left_semi")
    return long, sites


def zscores(spark, sf):
    long, sites = scored_inputs(spark, sf)
    return scoring.peer_zscores(long, sites)


def zscore_layer(spark, sf):
    return layer(spark, sf, "zscores", lambda: zscores(spark, sf))


def peer_zscores(spark, sf):
    return zscores(spark, sf).select(
        "site_id", "feature", r("z"), "score_reference", "score_peer_group_size"
    )


def anomaly_score(spark, sf):
    return scoring.anomaly_score(zscore_layer(spark, sf)).select(
        "site_id", r("anomaly_score"), "score_reference", "score_peer_group_size"
    )


def _rounded_scores(spark, sf):
    """Scores at nine decimals, so that ties and thresholds are engine-neutral."""
    def build():
        scores = scoring.anomaly_score(zscore_layer(spark, sf))
        return scores.withColumn("anomaly_score", F.round("anomaly_score", 9))

    return layer(spark, sf, "scores", build)


def anomaly_rank(spark, sf):
    return scoring.anomaly_rank(_rounded_scores(spark, sf)).select(
        "site_id", r("anomaly_score"), "anomaly_rank"
    )


def flag_anomalies(spark, sf):
    ranked = scoring.anomaly_rank(_rounded_scores(spark, sf))
    return scoring.flag_anomalies(ranked).select(
        "site_id", r("anomaly_score"), "anomaly_rank", "is_flagged", r("flag_threshold"),
        "score_reference", "score_peer_group_size",
    )


def anomaly_rank_ties(spark, sf):
    """Average ranks over heavily tied values: the raw event values."""
    events = view(spark, sf, "fx_events_obs").select("site_id", "feature", F.round("value", 0).alias("score"))
    return scoring.anomaly_rank(events, "score", "score_rank")


def anomaly_drivers(spark, sf):
    z = zscore_layer(spark, sf).withColumn("z", F.round("z", 9))
    return scoring.anomaly_drivers(z, DRIVER_Z).select(
        "site_id", "anomaly_drivers", "top_anomaly_driver", r("top_anomaly_driver_z")
    )


def knn_geo(spark, sf):
    edges = neighbours.geographic_neighbours(view(spark, sf, "fx_sites"), GEO_K)
    return edges.select("site_id", "peer_id", "rank", r("distance_m", 3))


def geo_anomaly(spark, sf):
    long, sites = scored_inputs(spark, sf)
    return scoring.geo_anomaly(long, sites, GEO_K).select(
        "site_id", r("geo_anomaly_score", 5), r("geo_peer_distance_km", 5), "geo_anomaly_rank"
    )


def score_sites(spark, sf):
    long, sites = scored_inputs(spark, sf)
    return scoring.score_sites(long, sites).select(
        "site_id", r("anomaly_score", 5), "anomaly_rank", "is_flagged", r("geo_anomaly_score", 5),
        "geo_anomaly_rank", "score_reference",
    )


def score_sites_geographic(spark, sf):
    long, sites = scored_inputs(spark, sf)
    settings = replace(ScoringSettings(), method="geographic_neighbours")
    return scoring.score_sites(long, sites, settings).select(
        "site_id", r("anomaly_score", 5), "anomaly_rank", "is_flagged", "score_reference"
    )


def _vectors(spark, sf):
    return view(spark, sf, "fx_vectors")


def knn_vector(spark, sf):
    edges = neighbours.vector_neighbours(_vectors(spark, sf).select("site_id", "vector"), 5)
    return edges.select("site_id", "peer_id", "rank", r("distance", 5))


def knn_planar(spark, sf):
    edges = neighbours.planar_neighbours(_vectors(spark, sf), 10)
    return edges.select("site_id", "peer_id", "rank", r("distance", 5))


def knn_shortlist_refine(spark, sf):
    vectors = _vectors(spark, sf)
    edges = neighbours.shortlist_refine(vectors, vectors.select("site_id", "vector"), 20, 5)
    return edges.select("site_id", "peer_id", "rank", r("distance", 5))


def peer_diagnostics(spark, sf):
    vectors = _vectors(spark, sf)
    found = peers.peer_diagnostics(
        vectors.select("site_id", "vector"), vectors.select("site_id", "x", "y"), PEERS
    )
    return found.select(
        "site_id", r("chem_knn_mean_distance", 5), r("umap_knn_mean_chem_distance", 5),
        r("hybrid_peer_mean_chem_distance", 5), r("peer_overlap_chem_umap"),
    )


def _typology(spark, sf):
    vectors = _vectors(spark, sf)
    edges = peers.final_peers(
        vectors.select("site_id", "x", "y"), vectors.select("site_id", "vector"), PEERS
    )
    return peers.peer_typology(edges, vectors.select("site_id", "wfd_type"), PEERS)


def peer_typology(spark, sf):
    return _typology(spark, sf).select(
        "site_id", r("peer_agreement_ratio"), "dominant_peer_type", "is_cross_type",
        "is_strong_agreement", F.array_join("peer_site_ids", ",").alias("peer_site_ids"),
    )


def resolve_type(spark, sf):
    typed = _vectors(spark, sf).select("site_id", "wfd_type")
    joined = typed.join(_typology(spark, sf), "site_id")
    return peers.resolve_type(joined, 0.4).select("site_id", "wfd_type_resolved", "wfd_type_inferred")


QUERIES = {
    "peer_zscores": peer_zscores,
    "anomaly_score": anomaly_score,
    "anomaly_rank": anomaly_rank,
    "anomaly_rank_ties": anomaly_rank_ties,
    "flag_anomalies": flag_anomalies,
    "anomaly_drivers": anomaly_drivers,
    "knn_geo": knn_geo,
    "geo_anomaly": geo_anomaly,
    "score_sites": score_sites,
    "score_sites_geographic": score_sites_geographic,
    "knn_vector": knn_vector,
    "knn_planar": knn_planar,
    "knn_shortlist_refine": knn_shortlist_refine,
    "peer_diagnostics": peer_diagnostics,
    "peer_typology": peer_typology,
    "resolve_type": resolve_type,
}

HAVERSINE = (
    "2 * 6371000.0 * atan2(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * "
    "cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)), sqrt(greatest(0.0, 1 - "
    "(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * "
    "pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"
)


def haversine_sql(a: str, b: str) -> str:
    return HAVERSINE.format(a=a, b=b)


def _geo_edges(sites: str) -> str:
    return f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY distance_m, peer_id) AS INTEGER) AS rank
  FROM (SELECT a.site_id, b.site_id AS peer_id, {haversine_sql("a", "b")} AS distance_m
        FROM {sites} a JOIN {sites} b ON a.site_id <> b.site_id)) WHERE rank <= 20"""


def _spread(column: str) -> str:
    return f"CASE WHEN {column} > 1e-12 THEN {column} ELSE 1 END"


CTES = {
    "sc_types": """
SELECT site_id, CASE WHEN wfd_type <> '' AND lower(wfd_type) <> 'nan' THEN wfd_type END AS t FROM sc_sites""",
    "sc_groups": "SELECT t, count(*) AS c FROM sc_types WHERE t IS NOT NULL GROUP BY t HAVING count(*) >= 10",
    "sc_refs": """
SELECT site_id, g.t AS rt, coalesce(g.t, 'global') AS score_reference,
       coalesce(g.c, (SELECT count(*) FROM sc_types)) AS score_peer_group_size
FROM sc_types LEFT JOIN sc_groups g USING (t)""",
    "zscores": f"""
SELECT site_id, feature, score_reference, score_peer_group_size,
       CASE WHEN rt IS NOT NULL THEN (value - tm) / ({_spread("ts")}) ELSE (value - gm) / ({_spread("gs")}) END AS z
FROM (SELECT *, avg(value) OVER (PARTITION BY rt, feature) AS tm, stddev_pop(value) OVER (PARTITION BY rt, feature) AS ts,
             avg(value) OVER (PARTITION BY feature) AS gm, stddev_pop(value) OVER (PARTITION BY feature) AS gs
      FROM filled JOIN sc_refs USING (site_id))""",
    "raw_scores": """
SELECT site_id, coalesce(sqrt(avg(z * z)), 0) AS exact_score, min(score_reference) AS score_reference,
       min(score_peer_group_size) AS score_peer_group_size FROM zscores GROUP BY site_id""",
    "scores": """
SELECT site_id, round(exact_score, 9) AS anomaly_score, score_reference, score_peer_group_size FROM raw_scores""",
    "ranked": """
SELECT *, CAST(floor(rank() OVER (ORDER BY anomaly_score DESC) +
       (count(*) OVER (PARTITION BY anomaly_score) - 1) / 2.0) AS INTEGER) AS anomaly_rank FROM scores""",
    "flagged": """
SELECT *, (SELECT quantile_cont(anomaly_score, 0.95) FROM scores) AS flag_threshold,
       anomaly_score >= (SELECT quantile_cont(anomaly_score, 0.95) FROM scores) AS is_flagged FROM ranked""",
    "z9": "SELECT site_id, feature, round(z, 9) AS z FROM zscores WHERE z IS NOT NULL",
    "drivers_text": f"""
SELECT site_id,
       coalesce(string_agg(feature, '|' ORDER BY abs(z) DESC, feature) FILTER (abs(z) >= {DRIVER_Z}), '') AS anomaly_drivers,
       first(feature ORDER BY abs(z) DESC, feature) AS top_anomaly_driver,
       first(z ORDER BY abs(z) DESC, feature) AS top_anomaly_driver_z
FROM z9 GROUP BY site_id""",
    "geo_edges": _geo_edges("fx_sites"),
    "sc_edges": _geo_edges("sc_sites"),
    "geo_scores": f"""
SELECT site_id, coalesce(sqrt(avg(z * z)), 0) AS geo_anomaly_score FROM (
  SELECT o.site_id, (o.value - m.m) / ({_spread("m.s")}) AS z
  FROM filled o JOIN (SELECT e.site_id, f.feature, avg(f.value) AS m, stddev_pop(f.value) AS s
                      FROM sc_edges e JOIN filled f ON f.site_id = e.peer_id GROUP BY ALL) m
    ON m.site_id = o.site_id AND m.feature = o.feature) GROUP BY site_id""",
    "geo_ranked": """
SELECT g.site_id, g.geo_anomaly_score,
       (SELECT avg(distance_m) / 6371000.0 * 6371.0088 FROM sc_edges e WHERE e.site_id = g.site_id) AS geo_peer_distance_km,
       CAST(floor(rank() OVER (ORDER BY geo_anomaly_score DESC) +
         (count(*) OVER (PARTITION BY geo_anomaly_score) - 1) / 2.0) AS INTEGER) AS geo_anomaly_rank
FROM geo_scores g""",
    "vec_pairs": """
SELECT a.site_id, b.site_id AS peer_id, list_distance(a.vector, b.vector) AS d,
       sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d2
FROM fx_vectors a JOIN fx_vectors b ON a.site_id <> b.site_id""",
    "chem_edges": """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY d, peer_id) AS INTEGER) AS rank
FROM vec_pairs) WHERE rank <= 5""",
    "plane_edges": """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY d2, peer_id) AS INTEGER) AS rank
FROM vec_pairs) WHERE rank <= 20""",
    "refined": """
SELECT * EXCLUDE (rank), nth AS rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY d, peer_id) AS INTEGER) AS nth FROM plane_edges)
WHERE nth <= 5""",
    "peer_mix": """
SELECT e.site_id, coalesce(p.wfd_type, 'Unknown') AS pt, count(*) AS n, min(rank) AS first_rank
FROM refined e JOIN fx_vectors p ON p.site_id = e.peer_id GROUP BY ALL""",
    "typology": """
SELECT v.site_id, v.wfd_type,
       CASE WHEN v.wfd_type IS NOT NULL THEN coalesce(sum(m.n) FILTER (m.pt = v.wfd_type), 0) / 5.0
            ELSE max(m.n) / 5.0 END AS peer_agreement_ratio,
       nullif(first(m.pt ORDER BY m.n DESC, m.first_rank), 'Unknown') AS dominant_peer_type,
       v.wfd_type IS NOT NULL AND coalesce(sum(m.n) FILTER (m.pt = v.wfd_type), 0) / 5.0 <= 0.4 AS is_cross_type,
       v.wfd_type IS NOT NULL AND coalesce(sum(m.n) FILTER (m.pt = v.wfd_type), 0) / 5.0 >= 0.8 AS is_strong_agreement
FROM fx_vectors v JOIN peer_mix m USING (site_id) GROUP BY v.site_id, v.wfd_type""",
}


def _sql(body: str) -> str:
    return sql(body, CTES)


ORACLES = {
    "peer_zscores": _sql("""
SELECT site_id, feature, round(z, 6) + 0.0 AS z, score_reference, score_peer_group_size FROM zscores"""),
    "anomaly_score": _sql("""
SELECT site_id, round(exact_score, 6) AS anomaly_score, score_reference, score_peer_group_size FROM raw_scores"""),
    "anomaly_rank": _sql("SELECT site_id, round(anomaly_score, 6) AS anomaly_score, anomaly_rank FROM ranked"),
    "anomaly_rank_ties": _sql("""
SELECT site_id, feature, score, CAST(floor(rank() OVER (ORDER BY score DESC) +
       (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS INTEGER) AS score_rank
FROM (SELECT site_id, feature, round(value, 0) AS score FROM fx_events_obs)"""),
    "flag_anomalies": _sql("""
SELECT site_id, round(anomaly_score, 6) AS anomaly_score, anomaly_rank, is_flagged,
       round(flag_threshold, 6) AS flag_threshold, score_reference, score_peer_group_size FROM flagged"""),
    "anomaly_drivers": _sql("""
SELECT site_id, anomaly_drivers, top_anomaly_driver, round(top_anomaly_driver_z, 6) + 0.0 AS top_anomaly_driver_z
FROM drivers_text"""),
    "knn_geo": _sql("SELECT site_id, peer_id, rank, round(distance_m, 3) AS distance_m FROM geo_edges"),
    "geo_anomaly": _sql("""
SELECT site_id, round(geo_anomaly_score, 5) AS geo_anomaly_score,
       round(geo_peer_distance_km, 5) AS geo_peer_distance_km, geo_anomaly_rank FROM geo_ranked"""),
    "score_sites": _sql("""
SELECT f.site_id, round(e.exact_score, 5) AS anomaly_score, anomaly_rank, is_flagged,
       round(geo_anomaly_score, 5) AS geo_anomaly_score, geo_anomaly_rank, f.score_reference
FROM flagged f JOIN geo_ranked USING (site_id) JOIN raw_scores e USING (site_id)"""),
    "score_sites_geographic": _sql("""
SELECT f.site_id, round(geo_anomaly_score, 5) AS anomaly_score, geo_anomaly_rank AS anomaly_rank,
       geo_anomaly_score >= (SELECT quantile_cont(geo_anomaly_score, 0.95) FROM geo_ranked) AS is_flagged,
       score_reference
FROM flagged f JOIN geo_ranked USING (site_id)"""),
    "knn_vector": _sql("SELECT site_id, peer_id, rank, round(d, 5) AS distance FROM chem_edges"),
    "knn_planar": _sql("SELECT site_id, peer_id, rank, round(d2, 5) AS distance FROM plane_edges WHERE rank <= 10"),
    "knn_shortlist_refine": _sql("SELECT site_id, peer_id, rank, round(d, 5) AS distance FROM refined"),
    "peer_diagnostics": _sql("""
SELECT c.site_id, round(c.m, 5) AS chem_knn_mean_distance, round(u.m, 5) AS umap_knn_mean_chem_distance,
       round(h.m, 5) AS hybrid_peer_mean_chem_distance, round(coalesce(o.n, 0) / 5.0, 6) AS peer_overlap_chem_umap
FROM (SELECT site_id, avg(d) AS m FROM chem_edges GROUP BY 1) c
JOIN (SELECT site_id, avg(d) AS m FROM plane_edges WHERE rank <= 5 GROUP BY 1) u USING (site_id)
JOIN (SELECT site_id, avg(d) AS m FROM refined GROUP BY 1) h USING (site_id)
LEFT JOIN (SELECT p.site_id, count(*) AS n FROM plane_edges p JOIN chem_edges q
             ON p.site_id = q.site_id AND p.peer_id = q.peer_id WHERE p.rank <= 5 GROUP BY 1) o USING (site_id)"""),
    "peer_typology": _sql("""
SELECT t.site_id, round(peer_agreement_ratio, 6) AS peer_agreement_ratio, dominant_peer_type, is_cross_type,
       is_strong_agreement, (SELECT string_agg(peer_id, ',' ORDER BY rank) FROM refined e WHERE e.site_id = t.site_id) AS peer_site_ids
FROM typology t"""),
    "resolve_type": _sql("""
SELECT site_id, CASE WHEN wfd_type IS NULL AND peer_agreement_ratio >= 0.4 THEN dominant_peer_type ELSE wfd_type END AS wfd_type_resolved,
       wfd_type IS NULL AND peer_agreement_ratio >= 0.4 AND dominant_peer_type IS NOT NULL AS wfd_type_inferred
FROM typology"""),
}
