"""Yearly storm-overflow returns: one table per company, headers in free wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatch.constants import OVERFLOW_HEADERS
from sitewatch.operators.feed import union_by_name


def match_header(columns: list[str], fragments: tuple[str, ...]) -> str | None:
    """First column whose lower-cased name contains one of the fragments."""
    return next((c for c in columns if any(f in c.lower() for f in fragments)), None)


def standard_return(df: DataFrame, year: int, source_name: str) -> DataFrame | None:
    """One table with standard names, all text; None without an outlet reference."""
    found = {target: match_header(df.columns, parts) for target, parts in OVERFLOW_HEADERS.items()}
    if found["outlet_ngr"] is None:
        return None
    columns = [
        F.col(f"`{source}`").cast("string").alias(target) for target, source in found.items() if source
    ]
    columns.append(F.lit(year).cast("long").alias("reporting_year"))
    if found["water_company"] is None:
        columns.append(F.lit(source_name.replace(str(year), "").strip()).alias("water_company"))
    return df.select(*columns)


def harmonise_overflow_returns(returns: list[tuple[DataFrame, int, str]]) -> DataFrame:
    """Union of ``(table, year, source name)`` items under the standard names."""
    frames = [standard_return(df, year, name) for df, year, name in returns]
    usable = [f for f in frames if f is not None]
    if not usable:
        raise ValueError("no return has an outlet reference column")
    return reduce(union_by_name, usable)
