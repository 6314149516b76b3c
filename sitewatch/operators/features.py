"""From statistics to scaled chemical signatures, in long form.

The working table is ``(site_id, feature, value)``: features are data, so adding
one changes no plan. It is pivoted only where a caller wants a wide table.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sitewatch import constants as C
from sitewatch.config import FeatureSettings
from sitewatch.functions.numeric import null_if_nan, unit_or_std
from sitewatch.functions.text import strip_code_zeros
from sitewatch.operators.order_statistics import LINEAR, grouped_quantiles

LONG = ["site_id", "feature", "value"]


class NoFeatures(ValueError):
    """No determinand qualifies as a feature."""


def _panel_table(spark: SparkSession, panel: dict[str, str]) -> DataFrame:
    rows = [(str(code), name) for code, name in panel.items()]
    table = spark.createDataFrame(rows, "panel_code string, feature string")
    return table.select(strip_code_zeros(F.col("panel_code")).alias("code_key"), "feature")


def choose_panel_features(stats: DataFrame, panel: dict[str, str]) -> DataFrame:
    """Codes of the data that match the panel: ``(determinand_code, feature)``."""
    codes = stats.select("determinand_code").distinct()
    keyed = codes.withColumn("code_key", strip_code_zeros(F.col("determinand_code")))
    lookup = F.broadcast(_panel_table(stats.sparkSession, panel))  # one row per panel entry
    return keyed.join(lookup, "code_key").select("determinand_code", "feature")


def choose_features_by_coverage(stats: DataFrame, settings: FeatureSettings) -> DataFrame:
    """(code, unit) pairs with enough observations at enough sites."""
    keys = ["determinand_code", "unit"]
    enough = stats.where(F.col("n") >= settings.min_obs_per_site_determinand)
    counts = enough.groupBy(*keys).agg(
        F.count_distinct("site_id").alias("n_sites"), F.min("determinant").alias("determinant")
    )
    medians = grouped_quantiles(enough, keys, "n", {"median_n_per_site": (0.5, LINEAR)})
    return (
        counts.where(F.col("n_sites") >= settings.min_sites_per_determinand)
        .join(medians, keys, "left")
        .select(
            *keys,
            "n_sites",
            "median_n_per_site",
            F.coalesce("determinant", "determinand_code").alias("feature"),
        )
    )


def select_features_join(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """Keep statistics whose code, or code and unit, was chosen."""
    keys = [k for k in ("determinand_code", "unit") if k in chosen.columns]
    return stats.join(chosen.select(*keys).distinct(), keys, "left_semi")


def select_features(stats: DataFrame, settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Chosen statistics with their ``feature`` name: panel first, else coverage.

    Which rule applies is decided by one row-existence probe on the codes.
    """
    panel = choose_panel_features(stats, settings.panel)
    if panel.isEmpty():
        panel = choose_features_by_coverage(stats, settings)
        if panel.isEmpty():
            raise NoFeatures("no determinand passed the coverage thresholds")
    keys = [k for k in ("determinand_code", "unit") if k in panel.columns]
    return stats.join(panel.select(*keys, "feature"), keys)


def signature_long(selected: DataFrame) -> DataFrame:
    """One median per (site, feature).

    A feature measured in several units keeps the one with most observations, then
    the alphabetically last unit and code.
    """
    best = F.max(
        F.when(
            F.col("median").isNotNull(),
            F.struct(
                F.col("n"), F.col("unit"), F.col("determinand_code"), F.col("median").alias("value")
            ),
        )
    )
    return selected.groupBy("site_id", "feature").agg(best["value"].alias("value"))


def signature_matrix(long: DataFrame, features: list[str]) -> DataFrame:
    """Wide form, one column per listed feature.

    The list is given, which saves Spark the extra pass that finds pivot values.
    """
    return long.groupBy("site_id").pivot("feature", features).agg(F.max("value"))


def unpivot_features(wide: DataFrame, features: list[str]) -> DataFrame:
    """Long form of a wide table; missing values are left out."""
    values = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    long = wide.select("site_id", *values).unpivot(["site_id"], features, "feature", "value")
    return long.withColumn("value", null_if_nan(F.col("value"))).where("value IS NOT NULL")


def site_meta_join(meta: DataFrame, coverage: DataFrame, signatures: DataFrame) -> DataFrame:
    return meta.join(coverage, "site_id", "left").join(signatures, "site_id")


def prune_features(long: DataFrame, min_coverage: float) -> DataFrame:
    """Features present at a sufficient share of the sites, with that share."""
    present = long.where(F.col("value").isNotNull())
    n_sites = long.agg(F.count_distinct("site_id").alias("n_sites"))
    return (
        present.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n_present"))
        .withColumn("coverage", F.col("n_present") / n_sites.scalar())
        .where(F.col("coverage") >= min_coverage)
    )


def keep_features(long: DataFrame, kept: DataFrame) -> DataFrame:
    return long.join(kept.select("feature"), "feature", "left_semi")


def prune_sites(long: DataFrame, n_features: int, max_missing: int) -> DataFrame:
    """Sites with few enough gaps, with ``n_features_present``."""
    allowed = min(max_missing, max(n_features - 1, 0))
    counts = long.groupBy("site_id").agg(F.count("value").alias("n_features_present"))
    return counts.where(F.lit(n_features) - F.col("n_features_present") <= allowed)


def feature_names(long: DataFrame) -> list[str]:
    """The feature list on the driver (as many names as the panel has)."""
    return [r["feature"] for r in long.select("feature").distinct().orderBy("feature").collect()]


def complete_grid(long: DataFrame, features: list[str]) -> DataFrame:
    """Every (site, feature) pair, with nulls for gaps."""
    held = long.groupBy("site_id").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("value").isNotNull(), F.struct("feature", "value")))
        ).alias("_held")
    )
    names = F.array(*[F.lit(f) for f in features])
    return held.select("site_id", "_held", F.explode(names).alias("feature")).select(
        "site_id", "feature", F.try_element_at("_held", F.col("feature")).alias("value")
    )


def feature_medians(long: DataFrame) -> DataFrame:
    return grouped_quantiles(long, ["feature"], "value", {"median": (0.5, LINEAR)})


def impute_median(grid: DataFrame) -> DataFrame:
    """Fill gaps with the feature's median over sites; adds ``is_imputed``."""
    medians = F.broadcast(feature_medians(grid))  # one row per feature
    return grid.join(medians, "feature", "left").select(
        "site_id",
        "feature",
        F.coalesce("value", "median").alias("value"),
        F.col("value").isNull().alias("is_imputed"),
    )


def standard_scale(long: DataFrame) -> DataFrame:
    """Population-standardised values; a constant feature becomes 0."""
    moments = F.broadcast(  # one row per feature
        long.groupBy("feature").agg(
            F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std")
        )
    )
    scaled = (F.col("value") - F.col("_mean")) / unit_or_std(F.col("_std"))
    return long.join(moments, "feature").select("site_id", "feature", scaled.alias("value"))


def to_vectors(long: DataFrame, column: str = "vector") -> DataFrame:
    """One array per site, in feature-name order (bounded by the feature count)."""
    ordered = F.array_sort(F.collect_list(F.struct("feature", "value")))
    return long.groupBy("site_id").agg(F.transform(ordered, lambda e: e["value"]).alias(column))


def embed_2d(scaled: DataFrame) -> DataFrame:
    """Two principal coordinates per site, ``(site_id, umap_x, umap_y)``.

    The covariance is summed on the executors and only a features-by-features
    matrix reaches the driver. Each axis points so that its loading of largest
    size is positive, which fixes the otherwise free sign.
    """
    vectors = to_vectors(scaled).withColumn("_features", array_to_vector("vector"))
    model = PCA(k=2, inputCol="_features", outputCol="_axes").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    axes = vector_to_array("_axes")
    return model.transform(vectors).select(
        "site_id",
        (axes[0] * F.lit(signs[0])).alias("umap_x"),
        (axes[1] * F.lit(signs[1])).alias("umap_y"),
    )


def feature_model(grid: DataFrame) -> DataFrame:
    """What later layers need to know: ``(position, feature, median, mean, std)``."""
    imputed = impute_median(grid)
    moments = imputed.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    rows = feature_medians(grid).join(moments, "feature")
    names = F.array_sort(F.collect_list("feature"))  # as many as features
    order = rows.agg(F.posexplode(names).alias("position", "feature"))
    return order.join(rows, "feature").select("position", "feature", "median", "mean", "std")


def feature_columns(
    df: DataFrame, panel: dict[str, str], model_features: list[str] | None = None
) -> list[str]:
    """Chemistry columns of a wide table: saved model, else panel, else by type."""
    for names in (model_features or [], list(panel.values())):
        present = [n for n in names if n in df.columns]
        if present:
            return present
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType)
        and f.name not in C.NON_FEATURE_COLUMNS
        and not f.name.startswith(C.GENERATED_PREFIXES)
        and not f.name.endswith(C.GENERATED_SUFFIXES)
    ]


def z_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if f.name.endswith("_z") and isinstance(f.dataType, NumericType)
    ]


def typology_join(sites: DataFrame, lookup: DataFrame | None) -> DataFrame:
    """Attach the typology lookup, one row per site; without one the type is null."""
    null_type = F.lit(None).cast("string").alias("wfd_type")
    if lookup is None:
        return sites.select("*", null_type)
    if "wfd_type" not in lookup.columns and "water_body_typology" in lookup.columns:
        lookup = lookup.withColumnRenamed("water_body_typology", "wfd_type")
    wanted = [c for c in C.TYPOLOGY_COLUMNS if c in lookup.columns]
    if "site_id" not in wanted or "wfd_type" not in wanted:
        return sites.select("*", null_type)
    rest: list[Column] = [F.col(c) for c in wanted if c != "site_id"]
    # min over a struct pre-aggregates per task, so repeated sites stay cheap.
    one_each = (
        lookup.where(F.col("site_id").isNotNull())
        .groupBy("site_id")
        .agg(F.min(F.struct(*rest)).alias("_row"))
        .select("site_id", "_row.*")
    )
    return sites.join(one_each, "site_id", "left")
