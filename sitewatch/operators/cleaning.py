"""Raw measurements to clean observations: one scan, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch import constants as C
from sitewatch.config import CleaningSettings
from sitewatch.functions.numeric import NUMBER_PATTERN

_TEXT_COLUMNS = ("determinand_code", "sample_material", "determinant", "unit")
BLANKS = " \t\r\n\f\x0b"
RESULT_PATTERN = r"^<?\s*(" + NUMBER_PATTERN.strip("^$") + r")\s*$"
STAGES = (
    "after_rename",
    "after_material",
    "after_determinands",
    "after_units",
    "after_parsing",
    "after_physical_range",
    "final",
)


class MissingColumns(ValueError):
    """The source lacks columns that the operator needs."""


def _require(df: DataFrame, columns: tuple[str, ...]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns("missing required columns: " + ", ".join(missing))


def harmonise_columns(df: DataFrame) -> DataFrame:
    """Map both header generations to canonical names; codes and labels are text.

    Where one table carries both spellings of a column, they are merged.
    """
    sources: dict[str, list[str]] = {}
    for name in df.columns:
        sources.setdefault(C.CANONICAL_COLUMNS.get(name, name), []).append(name)

    def merged(target: str, names: list[str]) -> Column:
        columns = [F.col(f"`{n}`") for n in names]
        column = columns[0] if len(columns) == 1 else F.coalesce(*columns)
        return (column.cast("string") if target in _TEXT_COLUMNS else column).alias(target)

    renamed = df.select(*[merged(t, names) for t, names in sources.items()])
    _require(renamed, C.REQUIRED_RAW_COLUMNS)
    return renamed


def harmonise_clean(df: DataFrame) -> DataFrame:
    """Second pass over already clean tables of older producers."""
    for old, new in C.LATE_RENAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if "year" not in df.columns and "sample_dt" in df.columns:
        df = df.withColumn("year", F.year("sample_dt"))
    _require(df, ("site_id", "determinand_code", "determinant", "unit", "value", "year"))
    for name in ("site_id", "determinand_code", "determinant", "unit"):
        df = df.withColumn(name, F.col(name).cast("string"))
    return df.withColumn("value", F.col("value").cast("double"))


# --- predicates ---------------------------------------------------------------


def kept_material(settings: CleaningSettings) -> Column:
    return F.col("sample_material").isin(*settings.keep_materials)


def kept_determinand(settings: CleaningSettings) -> Column:
    name = F.col("determinant")
    banned = dict.fromkeys(settings.exclude_determinands + C.ALWAYS_EXCLUDED_DETERMINANDS)
    tests = [~name.isin(*banned)] + [~name.rlike(p) for p in C.EXCLUDED_DETERMINAND_PATTERNS]
    return reduce(lambda a, b: a & b, tests)


def kept_unit(settings: CleaningSettings) -> Column:
    banned = dict.fromkeys(settings.exclude_units + C.ALWAYS_EXCLUDED_UNITS)
    return ~F.col("unit").isin(*banned)


def physically_possible() -> Column:
    too_warm = (F.col("determinant") == C.TEMPERATURE_DETERMINAND) & (
        F.col("value") > C.TEMPERATURE_LIMIT
    )
    return ~too_warm


def complete_row() -> Column:
    return F.col("value").isNotNull() & F.col("sample_dt").isNotNull() & F.col("site_id").isNotNull()


def plausible_value() -> Column:
    """Present and physically possible, in one test.

    The optimiser moves this test below the parsing and so repeats the parsing
    expression for every mention of ``value``; it is therefore mentioned once, and
    the coalesce keeps Spark from adding a null test of its own.
    """
    limit = F.when(
        F.col("determinant") == C.TEMPERATURE_DETERMINAND, F.lit(C.TEMPERATURE_LIMIT)
    ).otherwise(F.lit(float("inf")))
    return F.coalesce(F.col("value") <= limit, F.lit(False))


# --- operators ----------------------------------------------------------------


def filter_material(df: DataFrame, settings: CleaningSettings = CleaningSettings()) -> DataFrame:
    return df.where(kept_material(settings))


def exclude_determinands(df: DataFrame, settings: CleaningSettings = CleaningSettings()) -> DataFrame:
    return df.where(kept_determinand(settings))


def exclude_units(df: DataFrame, settings: CleaningSettings = CleaningSettings()) -> DataFrame:
    return df.where(kept_unit(settings))


def parse_censored(df: DataFrame, settings: CleaningSettings = CleaningSettings()) -> DataFrame:
    """Add ``is_left_censored`` and ``value``; "<x" counts as a share of x.

    The text is matched and cast once: later filters on ``value`` repeat this
    expression, so it is kept small enough for compiled code. A number beyond the range
    of doubles ("1e999") is no measurement and becomes null.
    """
    text = F.btrim(F.col("result_raw").cast("string"), F.lit(BLANKS))
    censored = text.startswith("<")
    number = F.regexp_extract(text, RESULT_PATTERN, 1).try_cast("double")
    below_zero = (F.col("determinant") == C.CLAMPED_DETERMINAND) & text.rlike("^<?-")
    share = (
        F.when(below_zero, F.lit(0.0))
        .when(censored, F.lit(float(settings.censored_factor)))
        .otherwise(F.lit(1.0))
    )
    # Not nullif: it mentions its argument twice, and each mention parses the text anew.
    value = F.transform(
        F.array(number * share + F.lit(0.0)), lambda v: F.when(F.abs(v) < F.lit(float("inf")), v)
    )[0]
    return df.withColumn("is_left_censored", censored).withColumn("value", value)


def physical_range_filter(df: DataFrame) -> DataFrame:
    return df.where(physically_possible())


def parse_sample_time(df: DataFrame) -> DataFrame:
    """Add ``sample_dt`` (naive timestamp) and ``year``; unreadable times are null."""
    source = F.col("sample_datetime")
    if dict(df.dtypes)["sample_datetime"] == "string":
        moment = source.try_cast("timestamp_ntz")
    else:
        moment = source.cast("timestamp_ntz")
    return df.withColumn("sample_dt", moment).withColumn("year", F.year("sample_dt"))


def drop_invalid(df: DataFrame) -> DataFrame:
    return df.where(complete_row())


def clean_observations(df: DataFrame, settings: CleaningSettings = CleaningSettings()) -> DataFrame:
    """The whole chain over a harmonised table. Catalyst fuses it into one stage."""
    df = filter_material(df, settings)
    df = exclude_determinands(df, settings)
    df = exclude_units(df, settings)
    df = parse_sample_time(parse_censored(df, settings))
    return df.where(plausible_value()).where(F.col("sample_dt").isNotNull() & F.col("site_id").isNotNull())


def stage_profile(df: DataFrame, settings: CleaningSettings = CleaningSettings()) -> DataFrame:
    """Rows, distinct sites and distinct determinands that reach each stage.

    The stages nest, so each row has a furthest stage and each site or determinand
    reaches as far as its furthest row. That turns fourteen distinct counts into
    one shuffle of pre-aggregated pairs. Null counts as one distinct value.
    """
    parsed = parse_sample_time(parse_censored(df, settings))
    gates = [
        kept_material(settings),
        kept_determinand(settings),
        kept_unit(settings),
        F.lit(True),
        physically_possible(),
        complete_row(),
    ]
    furthest: Column = F.lit(len(gates))
    for index in range(len(gates) - 1, -1, -1):
        furthest = F.when(F.coalesce(gates[index], F.lit(False)), furthest).otherwise(F.lit(index))
    pairs = (
        parsed.select("site_id", "determinant", furthest.alias("reached"))
        .groupBy("site_id", "determinant", "reached")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def tally(kind: str, key: str) -> DataFrame:
        return (
            pairs.groupBy(key)
            .agg(F.max("reached").alias("reached"))
            .groupBy("reached")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("reached", F.lit(kind).alias("kind"), "n")
        )

    rows = pairs.groupBy("reached").agg(F.sum("n").alias("n")).select(
        "reached", F.lit("rows").alias("kind"), "n"
    )
    counts = rows.unionByName(tally("sites", "site_id")).unionByName(
        tally("determinands", "determinant")
    )
    # A row that reached stage r is present in every stage up to r.
    spread = counts.withColumn("stage_no", F.explode(F.sequence(F.lit(0), F.col("reached"))))
    names = F.array(*[F.lit(s) for s in STAGES])

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    return spread.groupBy("stage_no").agg(
        F.element_at(names, F.first("stage_no") + 1).alias("stage"),
        total("rows").alias("n_rows"),
        total("sites").alias("n_sites"),
        total("determinands").alias("n_determinands"),
    )
