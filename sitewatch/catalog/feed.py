"""Queries over scored sites and the published feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewatch.catalog.base import PANEL, clean_layer, layer, r, sql
from sitewatch.catalog.pressures import CTES as PRESSURE_CTES
from sitewatch.catalog.pressures import _pressure as pressure_of
from sitewatch.catalog.scoring import CTES as SCORING_CTES
from sitewatch.catalog.scoring import DRIVER_Z, _rounded_scores, scored_inputs, zscore_layer
from sitewatch.config import ConfidenceSettings
from sitewatch.constants import DETERMINAND_CONTEXT, HEADLINES
from sitewatch.operators import feed, narrative, pressures, scoring, statistics

CONFIDENCE = ConfidenceSettings(well_visits=30, well_year=2001, moderate_visits=20, moderate_year=2000)
FEATURE_LIST = sorted(PANEL.values())

# Attributes that the proxies lack, derived from the rank in both engines alike.
_DERIVED = {
    "site_label": "concat(site_label, ' AT THE weir of ', region)",
    "area": "concat('Area ', CAST(anomaly_rank % 9 AS STRING))",
    "peer_agreement_ratio": "CASE WHEN anomaly_rank % 7 = 0 THEN NULL ELSE CAST(anomaly_rank % 6 AS DOUBLE) / CAST(5 AS DOUBLE) END",
    "dominant_peer_type": "CASE anomaly_rank % 3 WHEN 0 THEN NULL WHEN 1 THEN wfd_type ELSE 'Low, Calcareous' END",
    "is_cross_type": "anomaly_rank % 5 = 0",
    "is_strong_agreement": "anomaly_rank % 4 = 0",
    "wfd_type_resolved": "CASE WHEN wfd_type IS NULL AND anomaly_rank % 2 = 0 THEN 'Low, Small' ELSE wfd_type END",
    "water_body_name": "CASE WHEN anomaly_rank % 3 = 0 THEN concat('River ', region) END",
}


def scored(spark, sf):
    """Scored, flagged and explained sites, with their long z table."""
    z9 = zscore_layer(spark, sf).withColumn("z", F.round("z", 9))
    return layer(spark, sf, "scored", lambda: _build_scored(spark, sf, z9)), z9


def _build_scored(spark, sf, z9):
    _, sites = scored_inputs(spark, sf)
    flagged = scoring.flag_anomalies(scoring.anomaly_rank(_rounded_scores(spark, sf)))
    explained = flagged.join(scoring.anomaly_drivers(z9, DRIVER_Z), "site_id")
    coverage = statistics.site_coverage(clean_layer(spark, sf))
    table = explained.join(sites, "site_id").join(coverage, "site_id")
    derived = [F.expr(text).alias(name) for name, text in _DERIVED.items()]
    kept = [c for c in table.columns if c not in _DERIVED]
    return table.select(*kept, *derived)


def _feed(spark, sf):
    """Scored sites with confidence tier, drivers and summary."""
    table, z = scored(spark, sf)
    tiered = narrative.confidence_tier(table, CONFIDENCE)
    return narrative.with_display_name(
        narrative.narrate(narrative.driver_details(tiered, z, PANEL))
    )


def _with_drivers(spark, sf):
    table, z = scored(spark, sf)
    return narrative.driver_details(table, z, PANEL)


def confidence_tier(spark, sf):
    table, _ = scored(spark, sf)
    return narrative.confidence_tier(table, CONFIDENCE).select("site_id", "confidence_tier")


def severity_band(spark, sf):
    table, _ = scored(spark, sf)
    # Scores spread over all four bands.
    return narrative.with_severity(table.withColumn("anomaly_score", F.col("anomaly_score") * 4)).select(
        "site_id", "severity", "severity_label", "severity_description", "severity_colour"
    )


def coverage_labels(spark, sf):
    table, _ = scored(spark, sf)
    scaled = narrative.confidence_tier(table, CONFIDENCE).withColumn(
        "total_observations", F.col("total_observations") * 20
    ).withColumn("avg_days_between_visits", F.col("avg_days_between_visits") * (1 + F.col("anomaly_rank") % 5) / 5)
    return narrative.coverage_labels(scaled).select(
        "site_id", "frequency_label", "frequency_text", "evidence_band", "evidence_label",
        r("evidence_fill"), "confidence_band", "confidence_label",
    )


def peer_labels(spark, sf):
    table, _ = scored(spark, sf)
    return narrative.peer_labels(table).select(
        "site_id", "peer_matches", "peer_match_text", "typology_words", "peer_context",
        "comparison_label", "mismatch_suppressed",
    )


def context_sentences(spark, sf):
    table, _ = scored(spark, sf)
    return narrative.context_sentences(table).select("site_id", "reference_sentence", "peer_sentence")


def display_name(spark, sf):
    table, _ = scored(spark, sf)
    return narrative.with_display_name(table).select("site_id", "display_name")


def title_case_site(spark, sf):
    table, _ = scored(spark, sf)
    return narrative.with_title_case(table).select("site_id", "site_title")


def driver_details(spark, sf):
    exploded = _with_drivers(spark, sf).select("site_id", F.posexplode("drivers").alias("position", "d"))
    return exploded.select("site_id", "position", "d.*").withColumn("z", r(F.col("z"), 3))


def signed_profile(spark, sf):
    return narrative.signed_profile(_with_drivers(spark, sf), FEATURE_LIST).select(
        "site_id", "feature", r("signed_z", 3), "scale"
    )


def narrate(spark, sf):
    return _feed(spark, sf).select("site_id", "summary", F.size("drivers").alias("n_drivers"))


def public_headline(spark, sf):
    return narrative.public_headline(_with_drivers(spark, sf)).select("site_id", "headline_class", "headline")


def public_summary(spark, sf):
    blanked = _feed(spark, sf).withColumn(
        "summary", F.when(F.col("anomaly_rank") % 2 == 0, F.col("summary"))
    )
    return narrative.public_summary(blanked).select("site_id", "public_summary")


def site_record(spark, sf):
    record = narrative.site_record(_feed(spark, sf))
    return record.select(
        "site_id", "display_name", "anomaly_rank", r("anomaly_score", 4), "is_flagged", "first_sample",
        "last_sample", "distinct_sample_dates", "avg_days_between_visits", "confidence_tier",
        "peer_agreement_ratio", "dominant_peer_type", "wfd_type_inferred",
    )


def site_record_compact(spark, sf):
    return narrative.site_record(_feed(spark, sf), compact=True).select(
        "site_id", "anomaly_rank", "top_anomaly_driver", r("top_anomaly_driver_z"), "summary", "total_observations"
    )


def site_brief(spark, sf):
    return narrative.site_brief(_feed(spark, sf))


def ranked_feed(spark, sf):
    return feed.ranked_feed(_feed(spark, sf)).select("anomaly_rank", "site_id", "display_name", "is_flagged")


def flagged_summaries(spark, sf):
    return feed.flagged_summaries(_feed(spark, sf)).select("site_id", "anomaly_rank", "summary")


def top_sites(spark, sf):
    table, _ = scored(spark, sf)
    return feed.top_sites(table, 10).select("site_id", "anomaly_rank", "anomaly_drivers")


def feed_filter(spark, sf):
    with_incidents = pressures.merge_incidents(_feed(spark, sf), pressure_of(spark, sf))
    wanted = feed.FeedFilter(
        confidence_tiers=("moderate", "limited"), query=" Weir OF nation_1", incidents="has_incidents"
    )
    return feed.feed_filter(with_incidents, wanted).select("site_id", "anomaly_rank", "region")


def feed_filter_driver(spark, sf):
    wanted = feed.FeedFilter(driver="pH", severity="Moderate", metric="flagged", limit=None)
    return feed.feed_filter(_feed(spark, sf), wanted).select("site_id", "anomaly_rank")


def feed_header(spark, sf):
    header = feed.feed_header(
        _feed(spark, sf), statistics.data_period(clean_layer(spark, sf)), "typology_peers", FEATURE_LIST, PANEL
    )
    return header.select(
        "data_period_start", "data_period_end", "total_sites", "flagged_sites", "cross_type_sites",
        "scoring_method", F.array_join("feature_cols", "|").alias("features"),
        F.size("panel").alias("panel_size"),
    )


def feed_facets(spark, sf):
    return feed.feed_facets(_feed(spark, sf))


def geojson_features(spark, sf):
    return feed.geojson_features(_feed(spark, sf))


def _previous(table):
    """A previous release: present ranks pushed about, one site in eleven new."""
    shifted = (F.col("anomaly_rank") + F.col("anomaly_rank") * 7 % 5 * 10).cast("int")
    return table.where(F.col("anomaly_rank") % 11 != 0).select("site_id", shifted.alias("anomaly_rank"))


def rank_history_join(spark, sf):
    table, _ = scored(spark, sf)
    return feed.rank_history_join(table, _previous(table))


def rank_movers(spark, sf):
    table, _ = scored(spark, sf)
    return feed.rank_movers(feed.rank_history_join(table, _previous(table)))


def top50_entered_exited(spark, sf):
    table, _ = scored(spark, sf)
    return feed.top50_entered_exited(table, _previous(table))


QUERIES = {
    "confidence_tier": confidence_tier,
    "severity_band": severity_band,
    "coverage_labels": coverage_labels,
    "peer_labels": peer_labels,
    "context_sentences": context_sentences,
    "display_name": display_name,
    "title_case_site": title_case_site,
    "driver_details": driver_details,
    "signed_profile": signed_profile,
    "narrate": narrate,
    "public_headline": public_headline,
    "public_summary": public_summary,
    "site_record": site_record,
    "site_record_compact": site_record_compact,
    "site_brief": site_brief,
    "ranked_feed": ranked_feed,
    "flagged_summaries": flagged_summaries,
    "top_sites": top_sites,
    "feed_filter": feed_filter,
    "feed_filter_driver": feed_filter_driver,
    "feed_header": feed_header,
    "feed_facets": feed_facets,
    "geojson_features": geojson_features,
    "rank_history_join": rank_history_join,
    "rank_movers": rank_movers,
    "top50_entered_exited": top50_entered_exited,
}

# --- SQL ---------------------------------------------------------------------------------


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_CONTEXT = ", ".join("(" + ", ".join(_text(v) for v in row) + ")" for row in DETERMINAND_CONTEXT)
_HEADLINES = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in HEADLINES.items())
_GAP = (
    "CASE WHEN count(DISTINCT sample_dt) > 1 THEN floor(date_diff('second', min(sample_dt), max(sample_dt)) / 86400) "
    "/ count(DISTINCT sample_dt) END"
)
_NORMAL = "'Chemistry is consistent with similar rivers. No unusual patterns detected.'"
_CROSS = _text(
    "This river's water is within the normal range for its type overall. However, the rivers most chemically "
    "similar to it belong to different river types, which may reflect local conditions at the boundary between "
    "river classifications."
)
_TIERS = (
    "CASE least(CASE WHEN distinct_sample_dates >= 30 THEN 2 WHEN distinct_sample_dates >= 20 THEN 1 ELSE 0 END, "
    "CASE WHEN year(last_sample) >= 2001 THEN 2 WHEN year(last_sample) >= 2000 THEN 1 ELSE 0 END) "
    "WHEN 2 THEN 'well' WHEN 1 THEN 'moderate' ELSE 'limited' END"
)
_RENAMES = ", ".join(f"{text} AS {name}" for name, text in _DERIVED.items())

CTES = SCORING_CTES | PRESSURE_CTES | {
    "coverage": f"""
SELECT site_id, min(sample_dt) AS first_sample, max(sample_dt) AS last_sample, count(value) AS total_observations,
       count(DISTINCT sample_dt) AS distinct_sample_dates, {_GAP} AS avg_days_between_visits
FROM cleaned GROUP BY site_id""",
    "scored_raw": """
SELECT f.*, d.anomaly_drivers, d.top_anomaly_driver, d.top_anomaly_driver_z, s.site_label, s.region, s.lat, s.lon, s.wfd_type,
       c.first_sample, c.last_sample, c.total_observations, c.distinct_sample_dates, c.avg_days_between_visits
FROM flagged f JOIN drivers_text d USING (site_id) JOIN fx_sites s USING (site_id) JOIN coverage c USING (site_id)""",
    "site_scores": f"SELECT * EXCLUDE (site_label), {_RENAMES}, {_TIERS} AS confidence_tier, concat(site_label, ' at the Weir of Nation_', substr(region, 8)) AS display_name FROM scored_raw",
    "context": f"SELECT * FROM (VALUES {_CONTEXT}) AS t(name, label, high, low, unit)",
    "driver_rows": f"""
SELECT d.site_id, CAST(row_number() OVER (PARTITION BY d.site_id ORDER BY abs(d.z) DESC, d.feature) - 1 AS INTEGER) AS position,
       d.feature AS name, c.label, round(d.z, 3) + 0.0 AS z, CASE WHEN d.z > 0 THEN 'high' ELSE 'low' END AS direction,
       CASE WHEN d.z > 0 THEN c.high ELSE c.low END AS description, c.unit
FROM z9 d JOIN site_scores s USING (site_id) JOIN context c ON c.name = d.feature
WHERE abs(d.z) >= {DRIVER_Z} OR (s.anomaly_drivers = '' AND d.feature = s.top_anomaly_driver)""",
    "driver_lists": """
SELECT site_id, count(*) AS n, string_agg(description, '; ' ORDER BY position) AS listed,
       string_agg(description, '; ' ORDER BY position) FILTER (position > 0) AS rest,
       first(label ORDER BY position) AS top_label, first(name ORDER BY position) AS top_name FROM driver_rows GROUP BY site_id""",
    "told": f"""
SELECT s.*, CASE WHEN is_flagged THEN n ELSE 0 END AS n_drivers, CASE WHEN is_flagged THEN top_label END AS shown_label, CASE
  WHEN NOT is_flagged AND is_cross_type THEN {_CROSS}
  WHEN NOT is_flagged THEN {_NORMAL}
  WHEN anomaly_rank % 4 = 1 THEN concat(display_name, ' ranks #', anomaly_rank, ' nationally. ', said)
  WHEN anomaly_rank % 4 = 2 THEN concat('Elevated ', top_label, ' stands out at ', display_name, ', which ranks #', anomaly_rank,
    ' nationally for unusual chemistry. ', CASE WHEN n <= 1 THEN 'No other single chemical measure dominates the result.'
      WHEN n = 2 THEN concat('The main signal is ', rest, '.') ELSE concat('The main signals are ', rest, '.') END)
  WHEN anomaly_rank % 4 = 3 THEN concat('Among ', format('{{:,}}', score_peer_group_size), ' similar ',
    coalesce(wfd_type_resolved, wfd_type, score_reference), ' rivers, ', display_name,
    ' is one of the most chemically unusual (ranked #', anomaly_rank, ' nationally). ', said)
  ELSE concat(CASE WHEN water_body_name IS NOT NULL THEN concat('On the ', water_body_name, ' in ', region) ELSE concat('In ', region) END,
    ', ', display_name, ' shows chemistry that stands out from comparable rivers. ', said, ' It ranks #', anomaly_rank, ' nationally.')
  END AS summary
FROM (SELECT *, CASE WHEN n = 1 THEN concat('The main signal is ', listed, '.') ELSE concat('The main signals are ', listed, '.') END AS said
      FROM site_scores JOIN driver_lists USING (site_id)) s""",
    "previous": """
SELECT site_id, CAST(anomaly_rank + anomaly_rank * 7 % 5 * 10 AS INTEGER) AS old_rank FROM site_scores WHERE anomaly_rank % 11 <> 0""",
    "history": """
SELECT s.site_id, s.anomaly_rank AS new_rank, p.old_rank, p.old_rank - s.anomaly_rank AS rank_delta
FROM site_scores s JOIN previous p USING (site_id)""",
    "headed": """
SELECT site_id, CASE
  WHEN bool_or(lower(name) LIKE '%ammonia%' OR lower(name) LIKE '%ammoniacal%') THEN 'ammonia'
  WHEN bool_or(direction = 'low' AND lower(name) LIKE '%oxygen%') THEN 'low_oxygen'
  WHEN bool_or(direction = 'high' AND regexp_matches(lower(name), 'phosphate|nitrate|nitrite|nitrogen')) THEN 'nutrients'
  WHEN bool_or(direction = 'high' AND lower(name) LIKE '%conductivity%') THEN 'conductivity'
  WHEN bool_or(lower(name) LIKE '%ph%') THEN 'ph'
  WHEN bool_or(direction = 'high' AND lower(name) LIKE '%temperature%') THEN 'temperature'
  ELSE 'other' END AS headline_class FROM driver_rows GROUP BY site_id""",
}


def _sql(body: str) -> str:
    return sql(body, CTES)


def _band(score: str) -> str:
    return f"CASE WHEN {score} >= 8 THEN 'Extreme' WHEN {score} >= 4 THEN 'High' WHEN {score} >= 1.65 THEN 'Moderate' ELSE 'Lower' END"


_COLOUR = "CASE {b} WHEN 'Extreme' THEN '#991b1b' WHEN 'High' THEN '#dc2626' WHEN 'Moderate' THEN '#d97706' ELSE '#15803d' END"
_INTRO = "We compared this river''s water with the 5 most similar rivers across England. "
_WORDS = (
    "CASE trim(p) WHEN 'Low' THEN 'lowland altitude' WHEN 'Small' THEN 'small river size' "
    "WHEN 'Calcareous' THEN 'chalk or limestone geology' ELSE lower(trim(p)) END"
)
_PUBLIC_LABEL = "concat(upper(substr(shown_label, 1, 1)), substr(shown_label, 2))"

ORACLES = {
    "confidence_tier": _sql("SELECT site_id, confidence_tier FROM site_scores"),
    "severity_band": _sql(f"""
SELECT site_id, severity, CASE severity WHEN 'Extreme' THEN 'Very unusual' WHEN 'High' THEN 'Unusual'
         WHEN 'Moderate' THEN 'Some differences' ELSE 'Similar to others' END AS severity_label,
       CASE severity WHEN 'Extreme' THEN 'Readings are very different from similar rivers'
         WHEN 'High' THEN 'Readings are noticeably different from similar rivers'
         WHEN 'Moderate' THEN 'Some readings differ from similar rivers'
         ELSE 'Readings are similar to comparable rivers' END AS severity_description,
       {_COLOUR.format(b='severity')} AS severity_colour
FROM (SELECT site_id, {_band('anomaly_score * 4')} AS severity FROM site_scores)"""),
    "coverage_labels": _sql("""
SELECT site_id, frequency_label, CASE WHEN confidence_tier = 'limited' THEN 'No recent data'
         ELSE coalesce('Roughly ' || replace(frequency_label, ' sampling', ''), 'Sampling frequency unavailable') END AS frequency_text,
       evidence_band, concat(upper(substr(evidence_band, 1, 1)), substr(evidence_band, 2), ' evidence base') AS evidence_label,
       round(least(100.0, obs / 411 * 50), 6) AS evidence_fill,
       CASE confidence_tier WHEN 'well' THEN 'Strong' WHEN 'moderate' THEN 'Moderate' ELSE 'Limited' END AS confidence_band,
       CASE confidence_tier WHEN 'well' THEN 'Well-monitored' WHEN 'moderate' THEN 'Moderately monitored' ELSE 'Limited data' END AS confidence_label
FROM (SELECT *, CASE WHEN gap <= 14 THEN 'fortnightly sampling' WHEN gap <= 45 THEN 'monthly sampling' WHEN gap <= 120 THEN 'quarterly sampling'
               WHEN gap <= 270 THEN 'twice-yearly sampling' WHEN gap <= 450 THEN 'annual sampling' WHEN gap IS NOT NULL THEN 'infrequent sampling' END AS frequency_label,
             CASE WHEN obs >= 800 THEN 'strong' WHEN obs >= 400 THEN 'good' WHEN obs >= 200 THEN 'moderate' ELSE 'thin' END AS evidence_band
      FROM (SELECT *, total_observations * 20 AS obs, avg_days_between_visits * (1 + anomaly_rank % 5) / 5 AS gap FROM site_scores))"""),
    "peer_labels": _sql(f"""
SELECT site_id, n AS peer_matches, CASE WHEN n IS NULL THEN 'Chemical neighbourhood data is not available for this site.'
   ELSE concat('{_INTRO}', CASE
     WHEN n = 0 THEN 'None of the 5 are the same type of river, which suggests something may be changing this river''s natural character.'
     WHEN n <= 2 THEN concat('Only ', n, ' out of 5 ', CASE WHEN n = 1 THEN 'is' ELSE 'are' END,
       ' the same type of river, which suggests this river may not be behaving as expected for its type.')
     WHEN n = 3 THEN '3 out of 5 matching rivers are the same type, suggesting this river mostly fits its natural setting.'
     WHEN n = 4 THEN '4 out of 5 are the same type, suggesting this river''s water fits its natural setting.'
     ELSE 'All 5 are the same type. This river''s water fits what you''d expect for its natural setting.' END) END AS peer_match_text,
   words AS typology_words,
   CASE WHEN score_reference = 'global' THEN 'Compared against the 20 geographically nearest monitoring sites, because this river type has too few sites nationally for reliable group comparison.'
        ELSE concat('Compared against ', size, ' sites with the same natural characteristics: ', words, ' (WFD type: ', river_type, ').') END AS peer_context,
   concat(size, ' similar ', score_reference, ' rivers') AS comparison_label,
   coalesce(lower(dominant_peer_type), '') = '' OR lower(dominant_peer_type) = coalesce(lower(coalesce(wfd_type_resolved, wfd_type)), '∅') AS mismatch_suppressed
FROM (SELECT *, CAST(floor(peer_agreement_ratio * 5 + 0.5) AS INTEGER) AS n, format('{{:,}}', score_peer_group_size) AS size,
             coalesce(wfd_type_resolved, wfd_type, score_reference) AS river_type,
             array_to_string(list_transform(string_split(coalesce(wfd_type_resolved, wfd_type, score_reference), ','), lambda p: {_WORDS}), ', ') AS words
      FROM site_scores)"""),
    "context_sentences": _sql("""
SELECT site_id, CASE WHEN score_reference <> 'global' THEN concat(' Compared with similar ', score_reference, ' rivers, this profile looks unusual.')
    WHEN focal IS NOT NULL THEN concat(' The site is in WFD type ', focal, ', though scoring used a broader fallback reference.')
    ELSE ' The comparison uses the national chemistry reference because no usable WFD peer group was available.' END AS reference_sentence,
  CASE WHEN wfd_type IS NULL AND dominant <> 'Unknown' THEN concat(' This site has no official WFD classification, but its chemistry is consistent with ', dominant, ' rivers based on peer analysis.')
    WHEN wfd_type IS NOT NULL AND is_cross_type THEN concat(' Its chemistry looks out of character for a ', focal, ' river and is closer to ', dominant,
      ' rivers in the peer analysis. This suggests possible external pollution pressure and should be investigated further.')
    WHEN is_strong_agreement THEN concat(' Its chemical signature strongly aligns with its official ', coalesce(focal, 'Unknown'), ' classification.')
    ELSE '' END AS peer_sentence
FROM (SELECT *, coalesce(dominant_peer_type, focal, 'Unknown') AS dominant
      FROM (SELECT *, coalesce(wfd_type_resolved, wfd_type) AS focal FROM site_scores))"""),
    "display_name": _sql("SELECT site_id, display_name FROM site_scores"),
    "title_case_site": _sql("SELECT site_id, display_name AS site_title FROM site_scores"),
    "driver_details": _sql("SELECT * FROM driver_rows"),
    "signed_profile": _sql("""
SELECT s.site_id, f.feature, round(coalesce(d.z, 0), 3) + 0.0 AS signed_z,
       CAST(greatest(2, ceil(max(abs(coalesce(d.z, 0))) OVER (PARTITION BY s.site_id))) AS BIGINT) AS scale
FROM site_scores s CROSS JOIN (SELECT feature FROM panel) f LEFT JOIN driver_rows d ON d.site_id = s.site_id AND d.name = f.feature"""),
    "narrate": _sql("SELECT site_id, summary, n_drivers FROM told"),
    "public_headline": _sql(f"""
SELECT site_id, headline_class, CASE headline_class {_HEADLINES} END AS headline FROM headed"""),
    "public_summary": _sql(f"""
SELECT site_id, CASE WHEN anomaly_rank % 2 = 0 THEN summary ELSE concat(display_name, ' is ranked #', format('{{:,}}', anomaly_rank),
  ' nationally for unusual chemistry. Severity: ', {_band('anomaly_score')},
  '. More detail will appear when the next narrated feed is generated.') END AS public_summary FROM told"""),
    "site_record": _sql("""
SELECT site_id, display_name, anomaly_rank, round(anomaly_score, 4) AS anomaly_score, is_flagged,
       strftime(first_sample, '%Y-%m-%d') AS first_sample, strftime(last_sample, '%Y-%m-%d') AS last_sample,
       distinct_sample_dates, round(avg_days_between_visits, 1) AS avg_days_between_visits, confidence_tier,
       round(peer_agreement_ratio, 4) AS peer_agreement_ratio, coalesce(dominant_peer_type, 'Unknown') AS dominant_peer_type,
       false AS wfd_type_inferred FROM site_scores"""),
    "site_record_compact": _sql(f"""
SELECT site_id, anomaly_rank, top_anomaly_driver, round(top_anomaly_driver_z, 6) + 0.0 AS top_anomaly_driver_z,
       {_NORMAL} AS summary, total_observations FROM site_scores"""),
    "site_brief": _sql(f"""
SELECT site_id, CAST(to_json({{
  'site_name': display_name, 'site_id': site_id, 'national_rank': anomaly_rank, 'severity': {_band('anomaly_score')},
  'peer_group': coalesce(wfd_type, score_reference), 'peer_group_size': score_peer_group_size, 'wfd_status': 'Not available',
  'flagged_determinands': CASE WHEN is_flagged THEN (SELECT list({{'name': name, 'direction': direction, 'description': description}} ORDER BY position)
     FROM driver_rows d WHERE d.site_id = told.site_id) ELSE [] END,
  'cross_typology_match': coalesce(CAST(floor(peer_agreement_ratio * 5 + 0.5) AS INTEGER) || ' out of 5', 'Not available'),
  'cso_discharges': 0, 'cso_total_hours': CAST(0 AS DOUBLE),
  'regulated_discharge_points': {{'sewage_works': 0, 'storm_overflows': 0, 'industrial': 0}},
  'nearest_facility': 'Not available', 'waterbody': coalesce(water_body_name, 'Not available'), 'region': region,
  'data_confidence': confidence_tier}}) AS VARCHAR) AS brief FROM told"""),
    "ranked_feed": _sql("SELECT anomaly_rank, site_id, display_name, is_flagged FROM site_scores ORDER BY anomaly_rank, site_id"),
    "flagged_summaries": _sql("SELECT site_id, anomaly_rank, summary FROM told WHERE is_flagged"),
    "top_sites": _sql("SELECT site_id, anomaly_rank, anomaly_drivers FROM site_scores ORDER BY anomaly_rank, site_id LIMIT 10"),
    "feed_filter": _sql("""
SELECT site_id, anomaly_rank, region FROM told JOIN pressure USING (site_id)
WHERE confidence_tier IN ('moderate', 'limited') AND has_any_incidents
  AND contains(lower(concat_ws(' ', site_label, display_name, site_id, water_body_name, region, area)), 'weir of nation_1')
ORDER BY anomaly_rank, site_id LIMIT 250"""),
    "feed_filter_driver": _sql(f"""
SELECT site_id, anomaly_rank FROM told WHERE is_flagged AND {_band('anomaly_score')} = 'Moderate'
  AND site_id IN (SELECT site_id FROM driver_rows WHERE name = 'pH')"""),
    "feed_header": _sql("""
SELECT (SELECT strftime(min(sample_dt), '%Y-%m-%d') FROM cleaned) AS data_period_start,
       (SELECT strftime(max(sample_dt), '%Y-%m-%d') FROM cleaned) AS data_period_end,
       count(*) AS total_sites, count(*) FILTER (is_flagged) AS flagged_sites, count(*) FILTER (is_cross_type) AS cross_type_sites,
       'typology_peers' AS scoring_method, (SELECT string_agg(feature, '|' ORDER BY feature) FROM panel) AS features,
       CAST(5 AS INTEGER) AS panel_size FROM site_scores"""),
    "feed_facets": _sql("""
SELECT 'region' AS facet, region AS value, count(*) AS n FROM told GROUP BY region
UNION ALL SELECT 'confidence', CASE confidence_tier WHEN 'well' THEN 'well-monitored' ELSE confidence_tier END, count(*) FROM told GROUP BY 2
UNION ALL SELECT 'driver', name, count(*) FROM driver_rows JOIN told USING (site_id) WHERE is_flagged GROUP BY name"""),
    "geojson_features": _sql(f"""
SELECT site_id, CAST(to_json({{'type': 'Feature', 'geometry': {{'type': 'Point', 'coordinates': [lon, lat]}},
  'properties': {{'siteId': site_id, 'name': display_name, 'rank': anomaly_rank, 'severity': {_band('anomaly_score')},
    'driver': CASE WHEN n_drivers = 0 THEN 'No main driver listed' WHEN shown_label = 'pH' THEN 'pH' ELSE {_PUBLIC_LABEL} END,
    'flagged': is_flagged, 'color': {_COLOUR.format(b=_band('anomaly_score'))}}}}}) AS VARCHAR) AS feature FROM told"""),
    "rank_history_join": _sql("SELECT * FROM history"),
    "rank_movers": _sql("""
SELECT * FROM (SELECT 'largest' AS movement, * FROM history ORDER BY abs(rank_delta) DESC, site_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'up', * FROM history WHERE new_rank <= 200 OR old_rank <= 200 ORDER BY rank_delta DESC, site_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'down', * FROM history WHERE new_rank <= 200 OR old_rank <= 200 ORDER BY rank_delta, site_id LIMIT 10)"""),
    "top50_entered_exited": _sql("""
SELECT 'entered' AS change, site_id FROM site_scores WHERE anomaly_rank <= 50 AND site_id NOT IN (SELECT site_id FROM previous WHERE old_rank <= 50)
UNION ALL SELECT 'exited', site_id FROM previous WHERE old_rank <= 50 AND site_id NOT IN (SELECT site_id FROM site_scores WHERE anomaly_rank <= 50)"""),
}
