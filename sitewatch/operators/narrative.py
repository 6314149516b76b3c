"""Explanations per site, written as column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch import constants as C
from sitewatch.config import COMMON_CORE_PANEL, ConfidenceSettings
from sitewatch.functions.numeric import null_if_nan
from sitewatch.functions.text import (
    blank_to_null,
    display_name,
    first_filled,
    literal_map,
    public_chemical_label,
    round_half_up,
    severity_band,
    thousands,
    title_case_site,
    without_first,
)

TIERS = ("limited", "moderate", "well")
DRIVER_TYPE = (
    "array<struct<name:string,label:string,z:double,direction:string,"
    "description:string,unit:string>>"
)


def _optional(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """The column, or a typed null where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _false_if_null(df: DataFrame, name: str) -> Column:
    return F.coalesce(_optional(df, name, "boolean"), F.lit(False))


# --- names and bands ------------------------------------------------------------


def with_display_name(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "display_name",
        display_name(_optional(df, "site_label"), _optional(df, "site_name"), F.col("site_id")),
    )


def with_title_case(df: DataFrame) -> DataFrame:
    return df.withColumn("site_title", title_case_site(F.col("site_label")))


def confidence_tier(df: DataFrame, settings: ConfidenceSettings = ConfidenceSettings()) -> DataFrame:
    """The weaker of the visit tier and the recency tier."""
    visits = F.coalesce("distinct_sample_dates", F.lit(0))
    year = F.coalesce(F.year("last_sample"), F.lit(0))

    def grade(value: Column, moderate: int, well: int) -> Column:
        return F.when(value >= well, 2).when(value >= moderate, 1).otherwise(0)

    level = F.least(
        grade(visits, settings.moderate_visits, settings.well_visits),
        grade(year, settings.moderate_year, settings.well_year),
    )
    return df.withColumn(
        "confidence_tier", F.element_at(F.array(*[F.lit(t) for t in TIERS]), level + 1)
    )


def with_severity(df: DataFrame) -> DataFrame:
    band = severity_band(F.col("anomaly_score"))
    return df.select(
        "*",
        band.alias("severity"),
        F.element_at(literal_map(C.SEVERITY_LABELS), band).alias("severity_label"),
        F.element_at(literal_map(C.SEVERITY_DESCRIPTIONS), band).alias("severity_description"),
        F.element_at(literal_map(C.SEVERITY_COLOURS), band).alias("severity_colour"),
    )


def coverage_labels(df: DataFrame) -> DataFrame:
    """Sampling frequency, evidence band with fill, and confidence label."""
    gap = null_if_nan(F.col("avg_days_between_visits"))
    frequency: Column = F.lit(C.FREQUENCY_LOWEST)
    for limit, label in reversed(C.FREQUENCY_BANDS):
        frequency = F.when(gap <= limit, F.lit(label)).otherwise(frequency)
    frequency = F.when(gap.isNotNull(), frequency)
    rough = F.regexp_replace(frequency, " sampling$", "")
    count = F.coalesce("total_observations", F.lit(0))
    evidence: Column = F.lit(C.EVIDENCE_LOWEST)
    for floor, band in reversed(C.EVIDENCE_BANDS):
        evidence = F.when(count >= floor, F.lit(band)).otherwise(evidence)
    tier = F.col("confidence_tier")
    well = tier.isin("well", "well-monitored")
    return df.select(
        "*",
        frequency.alias("frequency_label"),
        F.when(tier == "limited", F.lit("No recent data"))
        .otherwise(F.coalesce(F.concat(F.lit("Roughly "), rough), F.lit("Sampling frequency unavailable")))
        .alias("frequency_text"),
        evidence.alias("evidence_band"),
        F.concat(F.initcap(evidence), F.lit(" evidence base")).alias("evidence_label"),
        F.least(F.lit(100.0), count / C.NATIONAL_OBSERVATION_MEDIAN * 50).alias("evidence_fill"),
        F.when(well, "Strong")
        .when(tier == "moderate", "Moderate")
        .when(tier.isNotNull(), "Limited")
        .otherwise("Unknown")
        .alias("confidence_band"),
        F.when(well, "Well-monitored")
        .when(tier == "moderate", "Moderately monitored")
        .when(tier.isNotNull(), "Limited data")
        .otherwise("Data coverage unavailable")
        .alias("confidence_label"),
    )


# --- drivers --------------------------------------------------------------------


def _context_map() -> Column:
    entries = []
    for name, label, high, low, unit in C.DETERMINAND_CONTEXT:
        entries += [
            F.lit(name),
            F.struct(
                F.lit(label).alias("label"),
                F.lit(high).alias("high"),
                F.lit(low).alias("low"),
                F.lit(unit).alias("unit"),
            ),
        ]
    return F.create_map(*entries)


def z_maps(z: DataFrame) -> DataFrame:
    """Known z-scores per site as a map (bounded by the feature count)."""
    known = F.when(F.col("z").isNotNull(), F.struct("feature", "z"))
    return z.groupBy("site_id").agg(F.map_from_entries(F.collect_list(known)).alias("z_by_feature"))


def driver_details(
    scored: DataFrame, z: DataFrame, panel: dict[str, str] = COMMON_CORE_PANEL
) -> DataFrame:
    """Add ``drivers``: one struct per listed driver, or the top one where none is."""
    listed = F.filter(
        F.transform(F.split(F.coalesce("anomaly_drivers", F.lit("")), r"\|"), lambda d: F.trim(d)),
        lambda d: d != "",
    )
    top = blank_to_null(F.col("top_anomaly_driver"))
    names = F.when((F.size(listed) > 0) | top.isNull(), listed).otherwise(F.array(top))
    panel_map, context = literal_map(panel), _context_map()

    def describe(raw: Column) -> Column:
        name = F.coalesce(F.try_element_at(panel_map, raw), raw)
        score = F.coalesce(
            F.try_element_at("z_by_feature", name), F.try_element_at("z_by_feature", raw)
        )
        known = F.try_element_at(context, name)
        label = F.coalesce(known["label"], name)
        direction = (
            F.when(score.isNull(), "unknown").when(score > 0, "high").otherwise("low")
        )
        phrase = (
            F.when(score.isNull(), F.concat(F.lit("unusual "), label))
            .when(known.isNull(), F.concat(direction, F.lit(" "), label))
            .when(score > 0, known["high"])
            .otherwise(known["low"])
        )
        return F.struct(
            name.alias("name"),
            label.alias("label"),
            F.round(score, 3).alias("z"),
            direction.alias("direction"),
            phrase.alias("description"),
            F.coalesce(known["unit"], F.lit("")).alias("unit"),
        )

    return (
        scored.join(z_maps(z), "site_id", "left")
        .withColumn("drivers", F.transform(names, describe))
        .drop("z_by_feature")
    )


def signed_profile(feed: DataFrame, features: list[str]) -> DataFrame:
    """Signed z per site and feature, 0 where not a driver, and the axis scale."""
    signed = F.map_from_entries(
        F.transform(
            F.coalesce("drivers", F.array().cast(DRIVER_TYPE)),
            lambda d: F.struct(
                d["name"].alias("feature"),
                F.when(d["direction"] == "low", -F.abs(d["z"])).otherwise(F.abs(d["z"])).alias("z"),
            ),
        )
    )
    names = F.array(*[F.lit(f) for f in features])
    values = F.transform(
        names,
        lambda n: F.struct(
            n.alias("feature"),
            F.coalesce(F.try_element_at(F.col("_signed"), n), F.lit(0.0)).alias("signed_z"),
        ),
    )
    widest = F.aggregate(
        "_values", F.lit(0.0), lambda acc, v: F.greatest(acc, F.abs(v["signed_z"]))
    )
    return (
        feed.select("site_id", signed.alias("_signed"))
        .select("site_id", values.alias("_values"))
        .select("site_id", F.greatest(F.lit(2), F.ceil(widest)).alias("scale"), F.inline("_values"))
    )


# --- sentences --------------------------------------------------------------------


def _sentence(drivers: Column) -> Column:
    parts = F.transform(drivers, lambda d: F.regexp_replace(d["description"], r"\.+$", ""))
    joined = F.array_join(parts, "; ")
    return (
        F.when(F.size(drivers) == 0, F.lit("No single chemical measure dominates the result."))
        .when(F.size(drivers) == 1, F.concat(F.lit("The main signal is "), joined, F.lit(".")))
        .otherwise(F.concat(F.lit("The main signals are "), joined, F.lit(".")))
    )


def _flagged_text(df: DataFrame) -> Column:
    drivers = F.col("drivers")
    name = display_name(_optional(df, "site_label"), _optional(df, "site_name"), F.col("site_id"))
    rank = F.col("anomaly_rank").cast("string")
    size = _optional(df, "score_peer_group_size", "long")
    peers = F.when(size != 0, thousands(size)).otherwise(F.lit("other"))
    river_type = first_filled(
        _optional(df, "wfd_type_resolved"),
        _optional(df, "wfd_type"),
        _optional(df, "score_reference"),
        F.lit("comparable"),
    )
    region = first_filled(_optional(df, "region"), F.lit("this region"))
    water_body = blank_to_null(_optional(df, "water_body_name"))
    place = F.when(
        water_body.isNotNull(), F.concat(F.lit("On the "), water_body, F.lit(" in "), region)
    ).otherwise(F.concat(F.lit("In "), region))
    rest = F.when(
        F.size(drivers) <= 1,
        F.lit("No other single chemical measure dominates the result."),
    ).otherwise(_sentence(F.slice(drivers, F.lit(2), F.size(drivers))))
    top_label = F.get(drivers, F.lit(0))["label"]
    signal = _sentence(drivers)
    # Fixed texts, one per remainder of the rank; wording 2 ignores the direction.
    wording = {
        1: F.concat(name, F.lit(" ranks #"), rank, F.lit(" nationally. "), signal),
        2: F.concat(
            F.lit("Elevated "), top_label, F.lit(" stands out at "), name, F.lit(", which ranks #"),
            rank, F.lit(" nationally for unusual chemistry. "), rest,
        ),
        3: F.concat(
            F.lit("Among "), peers, F.lit(" similar "), river_type, F.lit(" rivers, "), name,
            F.lit(" is one of the most chemically unusual (ranked #"), rank,
            F.lit(" nationally). "), signal,
        ),
        0: F.concat(
            place, F.lit(", "), name,
            F.lit(" shows chemistry that stands out from comparable rivers. "), signal,
            F.lit(" It ranks #"), rank, F.lit(" nationally."),
        ),
    }
    remainder = F.col("anomaly_rank") % 4
    text = wording[0]
    for value in (3, 2, 1):
        text = F.when(remainder == value, wording[value]).otherwise(text)
    return text


def narrate(feed: DataFrame) -> DataFrame:
    """Add ``summary``; sites that are not flagged lose their ``drivers``."""
    flagged = _false_if_null(feed, "is_flagged")
    summary = (
        F.when(
            ~flagged,
            F.when(_false_if_null(feed, "is_cross_type"), F.lit(C.CROSS_TYPE_SUMMARY)).otherwise(
                F.lit(C.NORMAL_SUMMARY)
            ),
        )
        .when(F.size("drivers") == 0, F.lit(C.NO_DRIVER_SUMMARY))
        .otherwise(_flagged_text(feed))
    )
    told = feed.withColumn("summary", summary)
    return told.withColumn(
        "drivers", F.when(flagged, F.col("drivers")).otherwise(F.array().cast(DRIVER_TYPE))
    )


def headline_class(drivers: Column) -> Column:
    """Class of the public headline: the first rule that any driver meets."""

    def named(*needles: str) -> Column:
        return F.exists(
            drivers,
            lambda d: _any_contains(F.lower(d["name"]), needles),
        )

    def pointing(direction: str, *needles: str) -> Column:
        return F.exists(
            drivers,
            lambda d: (d["direction"] == direction) & _any_contains(F.lower(d["name"]), needles),
        )

    return (
        F.when(named("ammonia", "ammoniacal"), "ammonia")
        .when(pointing("low", "oxygen"), "low_oxygen")
        .when(pointing("high", "phosphate", "nitrate", "nitrite", "nitrogen"), "nutrients")
        .when(pointing("high", "conductivity"), "conductivity")
        .when(named("ph"), "ph")
        .when(pointing("high", "temperature"), "temperature")
        .otherwise("other")
    )


def _any_contains(text: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def public_headline(feed: DataFrame) -> DataFrame:
    return feed.withColumn("headline_class", headline_class(F.col("drivers"))).withColumn(
        "headline", F.element_at(literal_map(C.HEADLINES), F.col("headline_class"))
    )


def public_summary(feed: DataFrame) -> DataFrame:
    """The narrated summary, or a stand-in while a site has none."""
    place = first_filled(F.col("display_name"), title_case_site(F.col("site_label")))
    stand_in = F.concat(
        place,
        F.lit(" is ranked #"),
        thousands(F.col("anomaly_rank")),
        F.lit(" nationally for unusual chemistry. Severity: "),
        severity_band(F.col("anomaly_score")),
        F.lit(". More detail will appear when the next narrated feed is generated."),
    )
    return feed.withColumn("public_summary", first_filled(F.col("summary"), stand_in))


def context_sentences(df: DataFrame) -> DataFrame:
    """Add ``reference_sentence`` and ``peer_sentence`` (empty where nothing to say)."""
    reference = blank_to_null(F.col("score_reference"))
    official = blank_to_null(F.col("wfd_type"))
    resolved = first_filled(F.col("wfd_type_resolved"), F.col("wfd_type"))
    first = (
        F.when(
            reference != "global",
            F.concat(
                F.lit(" Compared with similar "), reference, F.lit(" rivers, this profile looks unusual.")
            ),
        )
        .when(
            resolved.isNotNull(),
            F.concat(
                F.lit(" The site is in WFD type "), resolved,
                F.lit(", though scoring used a broader fallback reference."),
            ),
        )
        .otherwise(
            F.lit(
                " The comparison uses the national chemistry reference because no usable WFD "
                "peer group was available."
            )
        )
    )
    focal = F.coalesce(resolved, F.lit("Unknown"))
    dominant = first_filled(F.col("dominant_peer_type"), focal)
    known = dominant != "Unknown"
    closer = F.when(known, dominant).otherwise(F.lit("other monitored"))
    second = (
        F.when(
            official.isNull() & known,
            F.concat(
                F.lit(" This site has no official WFD classification, but its chemistry is consistent with "),
                dominant, F.lit(" rivers based on peer analysis."),
            ),
        )
        .when(
            official.isNotNull() & _false_if_null(df, "is_cross_type"),
            F.concat(
                F.lit(" Its chemistry looks out of character for a "), focal,
                F.lit(" river and is closer to "), closer,
                F.lit(
                    " rivers in the peer analysis. This suggests possible external pollution "
                    "pressure and should be investigated further."
                ),
            ),
        )
        .when(
            _false_if_null(df, "is_strong_agreement"),
            F.concat(
                F.lit(" Its chemical signature strongly aligns with its official "), focal,
                F.lit(" classification."),
            ),
        )
        .otherwise(F.lit(""))
    )
    return df.withColumn("reference_sentence", first).withColumn("peer_sentence", second)


# --- peer wording -------------------------------------------------------------------


def typology_words(label: Column) -> Column:
    parts = F.filter(
        F.transform(F.split(label, ","), lambda p: F.trim(p)), lambda p: p != ""
    )
    words = literal_map(C.TYPOLOGY_WORDS)
    return F.coalesce(
        F.transform(parts, lambda p: F.coalesce(F.try_element_at(words, p), F.lower(p))),
        F.array().cast("array<string>"),
    )


def peer_labels(df: DataFrame, k: int = 5) -> DataFrame:
    """Add the peer wordings shown with a site."""
    ratio = null_if_nan(F.col("peer_agreement_ratio"))
    n = round_half_up(ratio * k)
    intro = F.lit(
        f"We compared this river's water with the {k} most similar rivers across England. "
    )
    of_k = F.concat(n.cast("string"), F.lit(f" out of {k} "))
    verdict = (
        F.when(n == 0, F.lit(
            f"None of the {k} are the same type of river, which suggests something may be "
            "changing this river's natural character."
        ))
        .when(n <= 2, F.concat(
            F.lit("Only "), of_k, F.when(n == 1, "is").otherwise("are"),
            F.lit(" the same type of river, which suggests this river may not be behaving as expected for its type."),
        ))
        .when(n <= 3, F.concat(
            of_k, F.lit("matching rivers are the same type, suggesting this river mostly fits its natural setting."),
        ))
        .when(n <= 4, F.concat(
            of_k, F.lit("are the same type, suggesting this river's water fits its natural setting."),
        ))
        .otherwise(F.lit(
            f"All {k} are the same type. This river's water fits what you'd expect for its natural setting."
        ))
    )
    match_text = F.when(ratio.isNull(), F.lit(
        "Chemical neighbourhood data is not available for this site."
    )).otherwise(F.concat(intro, verdict))

    reference = blank_to_null(F.col("score_reference"))
    size = thousands(F.col("score_peer_group_size"))
    river_type = first_filled(F.col("wfd_type_resolved"), F.col("wfd_type"), reference)
    words = typology_words(river_type)
    count = F.coalesce(size, F.lit("similar"))
    geographic = F.lower(F.coalesce(reference, F.lit(""))).rlike("geographic|global")
    context = (
        F.when(geographic, F.lit(
            "Compared against the 20 geographically nearest monitoring sites, because this river "
            "type has too few sites nationally for reliable group comparison."
        ))
        .when(F.size(words) > 0, F.concat(
            F.lit("Compared against "), count, F.lit(" sites with the same natural characteristics: "),
            F.array_join(words, ", "), F.lit(" (WFD type: "), river_type, F.lit(")."),
        ))
        .otherwise(F.concat(F.lit("Compared against "), count, F.lit(" similar monitoring sites.")))
    )
    rivers = F.coalesce(
        F.concat(F.lit("similar "), reference, F.lit(" rivers")), F.lit("similar rivers")
    )
    official = F.lower(F.trim(first_filled(F.col("wfd_type_resolved"), F.col("wfd_type"), F.lit(" "))))
    peer = F.lower(F.trim(F.coalesce("dominant_peer_type", F.lit(""))))
    return df.select(
        "*",
        n.alias("peer_matches"),
        match_text.alias("peer_match_text"),
        F.array_join(words, ", ").alias("typology_words"),
        context.alias("peer_context"),
        F.coalesce(F.concat(size, F.lit(" "), rivers), rivers).alias("comparison_label"),
        (peer.isin("", "unknown") | ((official != "") & (official == peer))).alias("mismatch_suppressed"),
    )


# --- records ------------------------------------------------------------------------


def _iso_day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def _record_columns(df: DataFrame) -> dict[str, Column]:
    label = first_filled(_optional(df, "site_label"), _optional(df, "site_name"), F.col("site_id"))
    ratio = null_if_nan(_optional(df, "peer_agreement_ratio", "double"))
    return {
        "site_id": F.col("site_id"),
        "site_label": F.coalesce(label, F.lit("Unknown site")),
        "display_name": display_name(
            _optional(df, "site_label"), _optional(df, "site_name"), F.col("site_id")
        ),
        "lat": _optional(df, "lat", "double"),
        "lon": _optional(df, "lon", "double"),
        "region": _optional(df, "region"),
        "area": _optional(df, "area"),
        "sub_area": _optional(df, "sub_area"),
        "anomaly_rank": F.col("anomaly_rank").cast("int"),
        "anomaly_score": F.round("anomaly_score", 4),
        "is_flagged": _false_if_null(df, "is_flagged"),
        "flag_threshold": _optional(df, "flag_threshold", "double"),
        "score_reference": _optional(df, "score_reference"),
        "score_peer_group_size": _optional(df, "score_peer_group_size", "long"),
        "top_anomaly_driver": _optional(df, "top_anomaly_driver"),
        "top_anomaly_driver_z": _optional(df, "top_anomaly_driver_z", "double"),
        "total_observations": _optional(df, "total_observations", "long"),
        "first_sample": _iso_day(_optional(df, "first_sample", "date")),
        "last_sample": _iso_day(_optional(df, "last_sample", "date")),
        "distinct_sample_dates": _optional(df, "distinct_sample_dates", "long"),
        "avg_days_between_visits": F.round(
            null_if_nan(_optional(df, "avg_days_between_visits", "double")), 1
        ),
        "confidence_tier": F.col("confidence_tier"),
        "drivers": _optional(df, "drivers", DRIVER_TYPE),
        "summary": _optional(df, "summary"),
        "wfd_type": _optional(df, "wfd_type"),
        "wfd_type_resolved": _optional(df, "wfd_type_resolved"),
        "wfd_type_inferred": _false_if_null(df, "wfd_type_inferred"),
        "water_body_id": _optional(df, "water_body_id"),
        "water_body_name": _optional(df, "water_body_name"),
        "peer_agreement_ratio": F.round(ratio, 4),
        "dominant_peer_type": first_filled(_optional(df, "dominant_peer_type"), F.lit("Unknown")),
        "is_cross_type": _false_if_null(df, "is_cross_type"),
        "is_strong_agreement": _false_if_null(df, "is_strong_agreement"),
        "peer_site_ids": F.coalesce(
            _optional(df, "peer_site_ids", "array<string>"), F.array().cast("array<string>")
        ),
    }


_COMPACT_DROPS = (
    "region", "area", "sub_area", "flag_threshold", "score_reference", "score_peer_group_size",
    "drivers", "water_body_id", "water_body_name",
)
_FULL_DROPS = ("top_anomaly_driver", "top_anomaly_driver_z")


def site_record(df: DataFrame, compact: bool = False) -> DataFrame:
    """The published record of each site. The compact one has the plain summary."""
    columns = _record_columns(df)
    if compact:
        columns["summary"] = F.lit(C.NORMAL_SUMMARY)
    dropped = _COMPACT_DROPS if compact else _FULL_DROPS
    return df.select(*[c.alias(name) for name, c in columns.items() if name not in dropped])


def site_brief(feed: DataFrame) -> DataFrame:
    """One JSON payload per site for downstream text generation."""
    missing = F.lit("Not available")

    def text(*columns: Column) -> Column:
        return first_filled(*columns, missing)

    status = _optional(
        feed, "wfd_status", "struct<overall_status:string,ecological_status:string,chemical_status:string>"
    )
    facility = "struct<name:string,distance_m:int>"
    points = _optional(
        feed,
        "discharge_points",
        "struct<sewage_works_count:bigint,storm_overflows_count:bigint,"
        "industrial_discharges_count:bigint,total_discharge_points:bigint,"
        f"has_discharge_points:boolean,nearest_sewage_work:{facility},nearest_industrial:{facility}>",
    )
    incidents = _optional(
        feed, "incidents", "struct<total_edm_spills:bigint,total_spill_hours:double>"
    )
    ratio = null_if_nan(F.col("peer_agreement_ratio"))
    status_struct = F.struct(
        text(status["ecological_status"]).alias("ecological"),
        text(status["chemical_status"]).alias("chemical"),
        text(status["overall_status"]).alias("overall"),
    )
    # Absent status is a text in place of the object, so both are spelt as JSON.
    head = F.struct(
        first_filled(F.col("display_name"), F.col("site_label")).alias("site_name"),
        F.col("site_id"),
        F.col("anomaly_rank").alias("national_rank"),
        severity_band(F.col("anomaly_score")).alias("severity"),
        first_filled(F.col("wfd_type"), F.col("score_reference"), F.lit("Unknown")).alias("peer_group"),
        F.coalesce("score_peer_group_size", F.lit(0)).alias("peer_group_size"),
    )
    tail = F.struct(
        F.transform(
            F.coalesce("drivers", F.array().cast(DRIVER_TYPE)),
            lambda d: F.struct(d["name"].alias("name"), d["direction"].alias("direction"),
                               d["description"].alias("description")),
        ).alias("flagged_determinands"),
        F.coalesce(
            F.concat(round_half_up(ratio * 5).cast("string"), F.lit(" out of 5")), missing
        ).alias("cross_typology_match"),
        F.coalesce(incidents["total_edm_spills"], F.lit(0)).alias("cso_discharges"),
        F.coalesce(incidents["total_spill_hours"], F.lit(0.0)).alias("cso_total_hours"),
        F.struct(
            F.coalesce(points["sewage_works_count"], F.lit(0)).alias("sewage_works"),
            F.coalesce(points["storm_overflows_count"], F.lit(0)).alias("storm_overflows"),
            F.coalesce(points["industrial_discharges_count"], F.lit(0)).alias("industrial"),
        ).alias("regulated_discharge_points"),
        text(points["nearest_sewage_work"]["name"], points["nearest_industrial"]["name"]).alias(
            "nearest_facility"
        ),
        text(F.col("water_body_name")).alias("waterbody"),
        text(F.col("region")).alias("region"),
        text(F.col("confidence_tier")).alias("data_confidence"),
    )
    options = {"ignoreNullFields": "false"}
    status_json = F.when(status.isNotNull(), F.to_json(status_struct, options)).otherwise(
        F.lit('"Not available"')
    )
    body = F.to_json(head, options)
    payload = F.concat(
        F.substring(body, F.lit(1), F.length(body) - 1),
        F.lit(',"wfd_status":'),
        status_json,
        F.lit(","),
        without_first(F.to_json(tail, options)),
    )
    return feed.select("site_id", payload.alias("brief"))


def top_driver_label(drivers: Column) -> Column:
    first = F.get(drivers, F.lit(0))
    return F.coalesce(
        public_chemical_label(first_filled(first["label"], first["name"])),
        F.lit("No main driver listed"),
    )
