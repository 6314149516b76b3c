"""Release checks. Every check is one row ``(gate, check, passed, message, details)``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch import constants as C
from sitewatch.config import COMMON_CORE_PANEL, GateSettings
from sitewatch.functions.numeric import null_if_nan
from sitewatch.functions.text import strip_code_zeros, thousands
from sitewatch.operators.checkpoints import cut
from sitewatch.operators.feed import rank_history_join, rank_movers, top50_entered_exited
from sitewatch.operators.order_statistics import fractional_ranks
from sitewatch.sources.feed import read_feed_lines

DATA, RANKING, OUTPUT = "data_sanity", "ranking_quality", "output_quality"
DETAIL_ROWS = 50
CHECK_SCHEMA = "gate string, check string, passed boolean, message string, details string"


class GateFailed(RuntimeError):
    """A release check did not pass."""


def _check(
    measured: DataFrame, gate: str, name: str, passed: Column, message: Column, *details: str
) -> DataFrame:
    """One check row from a one-row table of measurements."""
    shown = list(details) or measured.columns
    return measured.select(
        F.lit(gate).alias("gate"),
        F.lit(name).alias("check"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        message.alias("message"),
        F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("details"),
    )


def _say(good: str, passed: Column, bad: Column) -> Column:
    return F.when(F.coalesce(passed, F.lit(False)), F.lit(good)).otherwise(bad)


def _single(spark: SparkSession, gate: str, name: str, passed: bool, message: str) -> DataFrame:
    return spark.createDataFrame([(gate, name, passed, message, None)], CHECK_SCHEMA)


# --- gate 1: clean observations ----------------------------------------------------


def gate_row_count(
    obs: DataFrame, previous_rows: int | None = None, settings: GateSettings = GateSettings()
) -> DataFrame:
    """Row count near the previous release's, or above the first-run floor."""
    return _row_count_check(obs.agg(F.count(F.lit(1)).alias("row_count")), previous_rows, settings)


def _row_count_check(counted: DataFrame, previous_rows: int | None, settings: GateSettings) -> DataFrame:
    n = F.col("row_count")
    if previous_rows:
        low = previous_rows * (1 - settings.row_count_tolerance)
        high = previous_rows * (1 + settings.row_count_tolerance)
        passed = n.between(low, high)
        expected = f" rows; expected {low:,.0f} to {high:,.0f}"
    else:
        passed = n >= settings.first_run_rows
        expected = f" rows; first run needs {settings.first_run_rows:,}"
    return _check(counted, DATA, "row_count", passed, F.concat(thousands(n), F.lit(expected)))


def gate_site_count(obs: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    # Two aggregates: distinct ids spread over tasks, and a null id counts once.
    return _site_count_check(obs.select("site_id").distinct().agg(F.count(F.lit(1)).alias("site_count")), settings)


def _site_count_check(counted: DataFrame, settings: GateSettings) -> DataFrame:
    n = F.col("site_count")
    message = F.concat(thousands(n), F.lit(f" sites; at least {settings.min_site_count:,} needed"))
    return _check(counted, DATA, "site_count", n >= settings.min_site_count, message)


def gate_determinands(
    obs: DataFrame, codes: tuple[str, ...] = tuple(COMMON_CORE_PANEL), normalise: bool = False
) -> DataFrame:
    """Every panel code occurs, as exact text unless ``normalise`` strips zeros."""
    code = F.col("determinand_code").cast("string")
    wanted = obs.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    if normalise:
        code, wanted = strip_code_zeros(code), wanted.select(strip_code_zeros(F.col("code")).alias("code"))
    present = obs.where(code.isin(*codes) if not normalise else code.isNotNull()).select(
        code.alias("code")
    ).distinct()
    missing = wanted.join(present, "code", "left_anti").agg(
        F.array_sort(F.collect_list("code")).alias("missing_codes")
    )
    return _determinands_check(missing)


def _determinands_check(missing: DataFrame) -> DataFrame:
    passed = F.size("missing_codes") == 0
    bad = F.concat(F.lit("Missing codes: "), F.array_join("missing_codes", ", "))
    return _check(
        missing, DATA, "determinands", passed, _say("All panel determinands present", passed, bad)
    )


def gate_null_rates(obs: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """Null share of the columns later layers need; an absent column fails."""

    def rate(name: str) -> Column:
        if name not in obs.columns:
            return F.max(F.lit(1.0)).alias(name)
        return F.coalesce(F.avg(F.col(name).isNull().cast("int")), F.lit(0.0)).alias(name)

    return _null_rates_check(obs.agg(*[rate(c) for c in C.GATE_COLUMNS]), settings)


def _null_rates_check(rates: DataFrame, settings: GateSettings) -> DataFrame:
    entries = F.array(
        *[F.when(F.col(c) > settings.max_null_rate, F.lit(c)) for c in C.GATE_COLUMNS]
    )
    failing = F.filter(entries, lambda c: c.isNotNull())
    passed = F.size(failing) == 0
    bad = F.concat(F.lit("Columns above threshold: "), F.array_join(failing, ", "))
    return _check(rates, DATA, "null_rates", passed, _say("Null rates are low", passed, bad))


def gate_value_ranges(obs: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """Configured bounds hold, every bounded determinand occurs, nothing is negative."""
    if "value" not in obs.columns or "determinant" not in obs.columns:
        return _single(obs.sparkSession, DATA, "value_ranges", False, "value or determinant is missing")
    aggregates = [F.count_if(F.col("value") < 0).alias("negative")]
    for i, (name, (low, high)) in enumerate(settings.value_ranges.items()):
        own = F.col("determinant") == name
        outside = own & ((F.col("value") < low) | (F.col("value") > high))
        aggregates += [F.count_if(own).alias(f"rows_{i}"), F.count_if(outside).alias(f"outside_{i}")]
    return _value_ranges_check(obs.agg(*aggregates), settings)


def _value_ranges_check(measured: DataFrame, settings: GateSettings) -> DataFrame:
    problems = [
        F.when((F.col(f"rows_{i}") == 0) | (F.col(f"outside_{i}") > 0), F.lit(name))
        for i, name in enumerate(settings.value_ranges)
    ]
    problems.append(F.when(F.col("negative") > 0, F.lit("non_negative_values")))
    failing = F.filter(F.array(*problems), lambda p: p.isNotNull())
    passed = F.size(failing) == 0
    bad = F.concat(F.lit("Range failures: "), F.array_join(failing, ", "))
    return _check(
        measured, DATA, "value_ranges", passed, _say("Values are inside their ranges", passed, bad)
    )


def gate_temporal(obs: DataFrame, as_of_year: int, settings: GateSettings = GateSettings()) -> DataFrame:
    years = obs.select(F.year("sample_dt").alias("year")).where("year IS NOT NULL").distinct()
    measured = years.agg(F.count(F.lit(1)).alias("n_years"), F.max("year").alias("latest_year"))
    return _temporal_check(measured, as_of_year, settings)


def _temporal_check(measured: DataFrame, as_of_year: int, settings: GateSettings) -> DataFrame:
    passed = (F.col("n_years") >= settings.min_years) & (
        F.lit(as_of_year) - F.col("latest_year") <= settings.max_age_years
    )
    message = F.format_string(
        "%d distinct years; latest is %s",
        F.col("n_years"),
        F.coalesce(F.col("latest_year").cast("string"), F.lit("none")),
    )
    return _check(measured, DATA, "temporal", passed, message)


def gate_regions(obs: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """Enough regions; without that column, enough site-id prefixes before "-"."""
    if "region" in obs.columns:
        names = obs.select("region").where("region IS NOT NULL")
    else:
        prefix = F.split(F.col("site_id").cast("string"), "-")[0]
        names = obs.select(prefix.alias("region")).where("region <> ''")
    return _regions_check(names.distinct().agg(F.count(F.lit(1)).alias("n_regions")), settings)


def _regions_check(measured: DataFrame, settings: GateSettings) -> DataFrame:
    n = F.col("n_regions")
    message = F.format_string(f"%d regions; at least {settings.min_regions} needed", n)
    return _check(measured, DATA, "regions", n >= settings.min_regions, message)


# --- gate 2: ranking ------------------------------------------------------------------


def _listed_ranks(scored: DataFrame, sites: tuple[str, ...]) -> DataFrame:
    listed = scored.sparkSession.createDataFrame([(s,) for s in sites], "site_id string")
    ranks = scored.where(F.col("site_id").isin(*sites)).select("site_id", "anomaly_rank")
    return listed.join(ranks, "site_id", "left")


def gate_known_bad(scored: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """Sites known to be bad rank near the top; an absent one fails."""
    low = F.col("anomaly_rank").isNull() | (F.col("anomaly_rank") > settings.known_bad_max_rank)
    measured = _listed_ranks(scored, settings.known_bad_sites).agg(
        F.count_if(low).alias("missing_or_low"),
        F.array_sort(F.collect_list(F.struct("site_id", "anomaly_rank"))).alias("sites"),
    )
    n = F.col("missing_or_low")
    bad = F.format_string(f"%d known-bad sites are not in the top {settings.known_bad_max_rank}", n)
    return _check(
        measured, RANKING, "known_bad", n == 0, _say("Known-bad sites rank high", n == 0, bad)
    )


def gate_known_clean(scored: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """Sites known to be clean do not rank near the top; an absent one passes."""
    measured = _listed_ranks(scored, settings.known_clean_sites).agg(
        F.count_if(F.col("anomaly_rank") <= settings.known_clean_min_rank).alias("too_high"),
        F.array_sort(F.collect_list(F.struct("site_id", "anomaly_rank"))).alias("sites"),
    )
    n = F.col("too_high")
    bad = F.format_string(f"%d known-clean sites are in the top {settings.known_clean_min_rank}", n)
    return _check(
        measured, RANKING, "known_clean", n == 0, _say("Known-clean sites rank low", n == 0, bad)
    )


def spearman(history: DataFrame) -> DataFrame:
    """``(overlap, spearman)`` of two releases, ties by average rank."""
    ranked = fractional_ranks(fractional_ranks(history, "old_rank", "_old"), "new_rank", "_new")
    return ranked.agg(
        F.count(F.lit(1)).alias("overlap"),
        null_if_nan(F.corr("_old", "_new")).alias("spearman"),
    )


def gate_rank_stability(
    scored: DataFrame, previous: DataFrame | None, settings: GateSettings = GateSettings()
) -> DataFrame:
    if previous is None:
        return _single(
            scored.sparkSession, RANKING, "rank_stability", True, "No previous release to compare with"
        )
    measured = spearman(rank_history_join(scored, previous))
    few = F.col("overlap") < 2
    passed = few | (F.col("spearman") >= settings.min_spearman)
    message = F.when(few, F.lit("Fewer than two shared sites")).otherwise(
        F.format_string("Rank correlation %.3f over %d sites", F.col("spearman"), F.col("overlap"))
    )
    return _check(measured, RANKING, "rank_stability", passed, message)


def corrected_skewness(n: Column, population: Column) -> Column:
    return F.when(n >= 3, population * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)))


def gate_score_skew(scored: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """Bias-corrected skewness of the scores: a few sites must stand out."""
    score = null_if_nan(F.col("anomaly_score"))
    moments = scored.agg(F.count(score).alias("n"), F.skewness(score).alias("_g1"))
    measured = moments.select(
        "n", null_if_nan(corrected_skewness(F.col("n"), F.col("_g1"))).alias("skewness")
    )
    message = F.when(F.col("skewness").isNull(), F.lit("Skewness cannot be computed")).otherwise(
        F.format_string("Score skewness is %.3f", F.col("skewness"))
    )
    return _check(measured, RANKING, "score_skew", F.col("skewness") > settings.min_skewness, message)


def gate_flag_band(scored: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    low, high = settings.flagged_range
    flagged = F.col("is_flagged") if "is_flagged" in scored.columns else F.lit(False)
    measured = scored.agg(F.count_if(flagged).alias("flagged"))
    message = F.format_string(f"%d flagged sites; expected {low} to {high}", F.col("flagged"))
    return _check(measured, RANKING, "flag_band", F.col("flagged").between(low, high), message)


def gate_drivers(scored: DataFrame, top: int = 20) -> DataFrame:
    first = scored.orderBy("anomaly_rank", "site_id").limit(top)
    listed = F.col("anomaly_drivers") if "anomaly_drivers" in scored.columns else F.lit(None).cast("string")
    empty = F.trim(F.coalesce(listed, F.lit(""))) == ""
    measured = first.agg(F.count_if(empty).alias("without_drivers"))
    n = F.col("without_drivers")
    bad = F.format_string(f"%d of the top {top} sites lack drivers", n)
    return _check(
        measured, RANKING, "drivers", n == 0, _say(f"The top {top} sites have drivers", n == 0, bad)
    )


def gate_peer_coverage(scored: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """Share of sites scored against a global fallback, with counts by keyword."""
    if "score_reference" not in scored.columns:
        return _single(scored.sparkSession, RANKING, "peer_coverage", False, "score_reference is missing")
    name = F.lower(F.coalesce("score_reference", F.lit("unknown")))
    typology = name.contains("wfd") | name.contains("typology") | name.contains("low,")
    counts = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(typology).alias("wfd_peers"),
        F.count_if(name.rlike("geographic|neighbou?r")).alias("geographic_neighbours"),
        F.count_if(name.rlike("global|fallback")).alias("global_fallback"),
    )
    known = F.col("wfd_peers") + F.col("geographic_neighbours") + F.col("global_fallback")
    share = F.coalesce(F.try_divide("global_fallback", "n"), F.lit(1.0))
    measured = counts.withColumn("other", F.greatest(F.lit(0), F.col("n") - known)).withColumn(
        "global_share", share
    )
    message = F.format_string("%.1f%% of sites used the global fallback", F.col("global_share") * 100)
    return _check(
        measured, RANKING, "peer_coverage", F.col("global_share") <= settings.max_global_share, message
    )


# --- gate 3: the feed -------------------------------------------------------------------


def gate_readable(spark: SparkSession, path: str) -> DataFrame:
    """The feed exists and every line parses and names a site.

    Counts entries and unreadable lines, and tells file and number of the first
    ``DETAIL_ROWS`` of them.
    """
    try:
        lines = cut(read_feed_lines(spark, path), "feed_lines")
    except (AnalysisException, FileNotFoundError) as error:
        return _single(spark, OUTPUT, "readable", False, f"Cannot read {path}: {type(error).__name__}")
    first = lines.where("not readable").select("file", "line").orderBy("file", "line").limit(DETAIL_ROWS)
    counted = lines.agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("readable")).alias("unreadable")).withColumn(
        "lines", first.agg(F.array_sort(F.collect_list(F.struct("file", "line"))).alias("l")).scalar()
    )
    passed = (F.col("unreadable") == 0) & (F.col("entries") > 0)
    message = F.format_string("%d entries, %d unreadable", F.col("entries"), F.col("unreadable"))
    return _check(counted, OUTPUT, "readable", passed, message)


def _failures(feed: DataFrame, failing: Column, *columns: str) -> DataFrame:
    """Failure count plus at most ``DETAIL_ROWS`` examples."""
    bad = F.coalesce(failing, F.lit(True))
    keep = ["site_id", *[c for c in columns if c in feed.columns]]
    examples = feed.where(bad).select(*keep).orderBy("site_id").limit(DETAIL_ROWS)
    listed = examples.agg(
        F.array_sort(F.collect_list(F.struct(*keep))).alias("examples")
    )
    return feed.agg(F.count_if(bad).alias("failures"), F.count(F.lit(1)).alias("entries")).withColumn(
        "examples", listed.scalar()
    )


def gate_schema(feed: DataFrame) -> DataFrame:
    """Required fields are present (null counts as absent after a JSON round trip)."""

    def absent(names: tuple[str, ...]) -> Column:
        test = F.lit(False)
        for name in names:
            test = test | (F.col(name).isNull() if name in feed.columns else F.lit(True))
        return test

    flagged = F.coalesce(F.col("is_flagged"), F.lit(False)) if "is_flagged" in feed.columns else F.lit(False)
    failing = absent(C.FEED_REQUIRED_FIELDS) | (flagged & absent(C.FEED_FLAGGED_FIELDS))
    measured = _failures(feed, failing)
    n = F.col("failures")
    bad = F.format_string("%d entries lack required fields", n)
    return _check(measured, OUTPUT, "schema", n == 0, _say("All entries are complete", n == 0, bad))


def gate_narratives(feed: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    text = F.trim(F.coalesce("summary", F.lit("")))
    weak = (F.length(text) <= settings.min_summary_length) | text.endswith("...")
    measured = _failures(feed.where(F.col("is_flagged")), weak, "anomaly_rank")
    n = F.col("failures")
    bad = F.format_string("%d flagged sites have weak summaries", n)
    return _check(
        measured, OUTPUT, "narratives", n == 0, _say("Flagged sites are fully narrated", n == 0, bad)
    )


def gate_coordinates(feed: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    def inside(name: str, bounds: tuple[float, float]) -> Column:
        return F.coalesce(F.col(name).try_cast("double").between(*bounds), F.lit(False))

    good = inside("lat", settings.lat_bounds) & inside("lon", settings.lon_bounds)
    measured = _failures(feed, ~good, "lat", "lon")
    n = F.col("failures")
    bad = F.format_string("%d entries lie outside the bounds", n)
    return _check(measured, OUTPUT, "coordinates", n == 0, _say("Coordinates are in bounds", n == 0, bad))


def gate_rank_continuity(feed: DataFrame) -> DataFrame:
    """Ranks are exactly 1..N. Distinct ranks are counted spread over tasks."""
    per_rank = feed.groupBy("anomaly_rank").agg(F.count(F.lit(1)).alias("_n"))
    measured = per_rank.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("entries"),
        F.count("anomaly_rank").alias("distinct_ranks"),
        F.min("anomaly_rank").alias("lowest"),
        F.max("anomaly_rank").alias("highest"),
    )
    n = F.col("entries")
    passed = (n == 0) | (
        (F.col("distinct_ranks") == n) & (F.col("lowest") == 1) & (F.col("highest") == n)
    )
    bad = F.lit("Ranks have gaps, duplicates or no value")
    return _check(measured, OUTPUT, "rank_continuity", passed, _say("Ranks run from 1 to N", passed, bad))


def gate_output_size(feed: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """Size of the feed as JSON lines, one newline per entry."""
    low, high = settings.size_mb_range
    line = F.to_json(F.struct(*feed.columns), {"ignoreNullFields": "false"})
    measured = feed.agg(
        (F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)) / (1024 * 1024)).alias("size_mb")
    )
    message = F.format_string(f"Output is %.2f MB; expected {low:.1f} to {high:.1f}", F.col("size_mb"))
    return _check(measured, OUTPUT, "output_size", F.col("size_mb").between(low, high), message)


def release_diff(feed: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Informational: who entered and left the top 50, and the largest movers.

    At most 50 + 50 + 10 + 10 rows reach the details.
    """
    if previous is None:
        return _single(feed.sparkSession, OUTPUT, "release_diff", True, "No previous release")
    changes = top50_entered_exited(feed, previous)
    movers = rank_movers(rank_history_join(feed, previous)).where(F.col("movement") != "largest")
    listed = changes.agg(
        F.array_sort(F.collect_list(F.struct("change", "site_id"))).alias("top_50"),
        F.count_if(F.col("change") == "entered").alias("entered"),
        F.count_if(F.col("change") == "exited").alias("exited"),
    )
    moved = movers.agg(F.array_sort(F.collect_list(F.struct(*movers.columns))).alias("m")).scalar()
    message = F.format_string("%d entered and %d left the top 50", F.col("entered"), F.col("exited"))
    return _check(
        listed.withColumn("movers", moved), OUTPUT, "release_diff", F.lit(True), message
    )


# --- running gates -------------------------------------------------------------------------


def measure_observations(
    obs: DataFrame,
    codes: tuple[str, ...] = tuple(COMMON_CORE_PANEL),
    settings: GateSettings = GateSettings(),
) -> DataFrame:
    """Everything gate 1 looks at, from one pass over the observations, as one written row.

    Each row counts for itself (kind ``all``) and for its site, code, year and region. Tasks
    add up per kind and key before anything is shuffled, so the shuffle holds one row per
    task and key, and the few keys are then counted. Beside the measures of the single
    gates the row has what is archived: codes, dates and regions.
    """
    names = obs.columns

    def column(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in names else F.lit(None).cast(kind)

    region = column("region") if "region" in names else F.nullif(F.split(column("site_id").cast("string"), "-")[0], F.lit(""))
    bounds = list(settings.value_ranges.items())
    value, determinant, moment = column("value", "double"), column("determinant"), column("sample_dt", "timestamp_ntz")
    nth = F.lit(-1)
    for i, (name, _) in enumerate(bounds):
        nth = F.when(determinant == name, F.lit(i)).otherwise(nth)
    outside = F.lit(False)
    for i, (_, (low, high)) in enumerate(bounds):
        outside = F.when(nth == i, (value < low) | (value > high)).otherwise(outside)

    def entry(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))

    keyed = F.array(
        entry("all", F.lit("")),
        entry("site", column("site_id")),
        entry("code", column("determinand_code")),
        entry("year", F.year(moment)),
        entry("region", region),
        entry("bounded", F.when(nth >= 0, nth)),
    )
    nulls = [f"null_{i}" for i in range(len(C.GATE_COLUMNS))]
    flags = {n: F.col(c).isNull() if c in names else F.lit(True) for n, c in zip(nulls, C.GATE_COLUMNS)}
    flags |= {"negative": F.coalesce(value < 0, F.lit(False)), "outside": F.coalesce(outside, F.lit(False))}
    wide = obs.select(keyed.alias("keyed"), moment.alias("moment"), *[c.cast("int").alias(n) for n, c in flags.items()])
    tally = (
        wide.select(F.inline("keyed"), *[c for c in wide.columns if c != "keyed"])
        .where("kind in ('all', 'site') or key is not null")
        .groupBy("kind", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("moment").alias("first"), F.max("moment").alias("last"), *[F.sum(n).alias(n) for n in flags])
    )

    def of(kind: str) -> Column:
        return F.col("kind") == kind

    def total(name: str, test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(name))), F.lit(0))

    def keys(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(of(kind), F.col("key"))))

    rows = total("n", of("all"))
    measured = tally.agg(
        rows.alias("row_count"),
        F.count_if(of("site")).alias("site_count"),
        keys("code").alias("determinand_codes"),
        *[
            F.when(F.lit(c not in names), F.lit(1.0)).otherwise(F.coalesce(total(n, of("all")) / F.nullif(rows, F.lit(0)), F.lit(0.0))).alias(c)
            for n, c in zip(nulls, C.GATE_COLUMNS)
        ],
        total("negative", of("all")).alias("negative"),
        *[total("n", of("bounded") & (F.col("key") == str(i))).alias(f"rows_{i}") for i in range(len(bounds))],
        *[total("outside", of("bounded") & (F.col("key") == str(i))).alias(f"outside_{i}") for i in range(len(bounds))],
        F.count_if(of("year")).alias("n_years"),
        F.max(F.when(of("year"), F.col("key").cast("int"))).alias("latest_year"),
        keys("region").alias("regions"),
        F.min(F.when(of("all"), F.col("first"))).alias("date_min"),
        F.max(F.when(of("all"), F.col("last"))).alias("date_max"),
    )
    missing = F.filter(F.array(*[F.lit(c) for c in sorted(codes)]), lambda c: ~F.array_contains("determinand_codes", c))
    return cut(measured.withColumn("missing_codes", missing).withColumn("n_regions", F.size("regions").cast("long")), "gate_1")


def checks_of_observations(
    measured: DataFrame,
    columns: list[str],
    as_of_year: int,
    previous_rows: int | None = None,
    settings: GateSettings = GateSettings(),
) -> DataFrame:
    """The checks of gate 1 from the row of :func:`measure_observations`.

    ``columns`` are those of the observations, some of which may be missing.
    """
    bounded = range(len(settings.value_ranges))
    if "value" in columns and "determinant" in columns:
        ranges = _value_ranges_check(
            measured.select("negative", *[f"{kind}_{i}" for i in bounded for kind in ("rows", "outside")]), settings
        )
    else:
        ranges = _single(measured.sparkSession, DATA, "value_ranges", False, "value or determinant is missing")
    return _union(
        _row_count_check(measured.select("row_count"), previous_rows, settings),
        _site_count_check(measured.select("site_count"), settings),
        _determinands_check(measured.select("missing_codes")),
        _null_rates_check(measured.select(*C.GATE_COLUMNS), settings),
        ranges,
        _temporal_check(measured.select("n_years", "latest_year"), as_of_year, settings),
        _regions_check(measured.select("n_regions"), settings),
    )


def gate_1(
    obs: DataFrame,
    as_of_year: int,
    previous_rows: int | None = None,
    settings: GateSettings = GateSettings(),
) -> DataFrame:
    return checks_of_observations(measure_observations(obs, settings=settings), obs.columns, as_of_year, previous_rows, settings)


def gate_metadata(measured: DataFrame) -> DataFrame:
    """What is kept of a passed gate 1, for the next release to compare with."""
    return measured.select(
        F.current_timestamp().cast("string").alias("timestamp"),
        "row_count", "site_count", "determinand_codes", "date_min", "date_max", "regions",
    )


def gate_2(
    scored: DataFrame, previous: DataFrame | None = None, settings: GateSettings = GateSettings()
) -> DataFrame:
    return _union(
        gate_known_bad(scored, settings),
        gate_known_clean(scored, settings),
        gate_rank_stability(scored, previous, settings),
        gate_score_skew(scored, settings),
        gate_flag_band(scored, settings),
        gate_drivers(scored),
        gate_peer_coverage(scored, settings),
    )


def gate_3(
    feed: DataFrame, previous: DataFrame | None = None, settings: GateSettings = GateSettings()
) -> DataFrame:
    return _union(
        gate_schema(feed),
        gate_narratives(feed, settings),
        gate_coordinates(feed, settings),
        gate_rank_continuity(feed),
        gate_output_size(feed, settings),
        release_diff(feed, previous),
    )


def _union(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def run_gates(checks: DataFrame, report_path: str | None = None, halt: bool = True) -> list:
    """Evaluate check rows once, write the report, and raise when one failed."""
    rows = checks.collect()  # one row per check
    if report_path:
        checks.sparkSession.createDataFrame(rows, CHECK_SCHEMA).coalesce(1).write.mode(
            "overwrite"
        ).json(report_path)
    failed = [r["check"] for r in rows if not r["passed"]]
    if failed and halt:
        raise GateFailed("failed checks: " + ", ".join(failed))
    return rows
