"""Text column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewatch import constants as C


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def without_first(value: Column, count: int = 1) -> Column:
    """The text after its first characters, however long it is."""
    return F.substring(value, F.lit(1 + count), F.length(value))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def strip_code_zeros(code: Column) -> Column:
    """Join key of a determinand code: no leading zeros, an all-zero code stays."""
    trimmed = F.trim(code)
    return F.coalesce(blank_to_null(F.regexp_replace(trimmed, "^0+", "")), trimmed)


def title_every_word(name: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere."""
    tokens = F.split(name, r"(?<=[^\p{L}])(?=\p{L})")
    cased = F.transform(
        tokens, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(without_first(t)))
    )
    return F.array_join(cased, "")


def display_name(site_label: Column, site_name: Column, site_id: Column) -> Column:
    source = first_filled(site_label, site_name, site_id)
    titled = title_every_word(F.coalesce(source, F.lit("Unknown site")))
    for word in C.DISPLAY_SMALL_WORDS:
        titled = F.replace(titled, F.lit(f" {word} "), F.lit(f" {word.lower()} "))
    return titled


def title_case_site(label: Column) -> Column:
    """Public title: every token capitalised except small words after the first."""
    tokens = F.split(F.lower(label), r"(?<=[\s/-])(?=[^\s/-])|(?<=[^\s/-])(?=[\s/-])")
    small = F.array(*[F.lit(w) for w in C.TITLE_SMALL_WORDS])
    cased = F.transform(
        tokens,
        lambda t, i: F.when(~t.rlike("[a-z]") | ((i > 0) & F.array_contains(small, t)), t).otherwise(
            F.concat(F.upper(F.substring(t, 1, 1)), without_first(t))
        ),
    )
    return F.when(
        blank_to_null(label).isNull(), F.lit("Unnamed monitoring site")
    ).otherwise(F.array_join(cased, ""))


def literal_map(pairs: dict[str, str]) -> Column:
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.create_map(*entries)


def replace_first(value: Column, old: str, new: str) -> Column:
    """Replace the first occurrence; refers to ``value`` once, so calls may nest."""
    return F.regexp_replace(value, r"(?s)^(.*?)\Q" + old + r"\E", "$1" + new)


def public_chemical_label(name: Column) -> Column:
    label = name
    for old, new in C.PUBLIC_LABELS:
        label = replace_first(label, old, new)
    # A one-element array binds the label, which is used several times below.
    cased = F.transform(
        F.array(label),
        lambda t: F.when(t == "pH", t).otherwise(
            F.concat(F.upper(F.substring(t, 1, 1)), without_first(t))
        ),
    )
    return F.element_at(cased, 1)


def severity_band(score: Column) -> Column:
    expr = F.lit(C.SEVERITY_LOWEST)
    for floor, band in reversed(C.SEVERITY_BANDS):
        expr = F.when(score >= floor, F.lit(band)).otherwise(expr)
    return expr


def round_half_up(value: Column) -> Column:
    """Whole number nearest to the value, halves upward."""
    return F.floor(value + F.lit(0.5)).cast("int")
