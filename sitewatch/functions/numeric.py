"""Numeric column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BINS_PER_OCTAVE = 64
_BIN_ORIGIN = 100_000  # above 64 * 1074, so that every magnitude maps above zero


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a plain decimal number is null.

    The pattern keeps out spellings only the JVM accepts ("12d", "NaN").
    """
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def is_finite(value: Column) -> Column:
    """True for a usable coordinate: neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def order_bin(value: Column) -> Column:
    """A bin number that never decreases as the value grows.

    Bins have constant relative width, so any set of doubles falls into at most
    about 270,000 of them whatever its range or row count. Infinite values have the
    outermost bins.
    """
    size = F.abs(value)
    inside = (F.floor(F.log2(size) * BINS_PER_OCTAVE) + _BIN_ORIGIN).try_cast("int")
    magnitude = F.when(size == float("inf"), F.lit(10 * _BIN_ORIGIN)).otherwise(inside)
    return F.when(value == 0, F.lit(0)).when(value > 0, magnitude).otherwise(-magnitude)


def order_bits(value: Column) -> Column:
    """The 64 bits of a double as an integer that grows with the value; both zeros are 0.

    Exact, by arithmetic with powers of two: the exponent found by the logarithm is put
    right by one comparison with the powers beside it.
    """

    def let(column: Column, body: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(column), body)[0]

    def power(e: Column) -> Column:
        return F.pow(F.lit(2.0), e)

    def normal(size: Column) -> Column:
        def exact(e: Column) -> Column:
            return F.when(power(e) > size, e - 1).when(size / power(e) >= 2, e + 1).otherwise(e)

        def packed(e: Column) -> Column:
            return (e + 1023) * F.lit(2**52) + ((size / power(e) - 1) * F.lit(2.0**52)).cast("long")

        guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)).cast("long")
        return let(let(guess, exact), packed)

    def bits(size: Column) -> Column:
        return (
            F.when(size == 0, F.lit(0).cast("long"))
            .when(size < F.lit(2.0**-1022), (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long"))
            .when(size == float("inf"), F.lit(0x7FF << 52))
            .otherwise(normal(size))
        )

    return F.when(value < 0, -bits(-value)).otherwise(bits(value))


def unit_or_std(std: Column, tolerance: float = 1e-12) -> Column:
    """A spread to divide by: missing, non-finite or vanishing spread becomes 1."""
    usable = is_finite(std) & (std > F.lit(tolerance))
    return F.when(usable, std).otherwise(F.lit(1.0))


def round_to_int(value: Column) -> Column:
    """Whole number nearest to the value, halves to the even neighbour."""
    return F.bround(value, 0).cast("int")


def rounded(value: Column, digits: int) -> Column:
    """``F.round`` of a double, without its detour through decimal text where no tie is near.

    The nearest whole number of units is the same for every way to round, unless the value
    lies within a millionth of a unit of a tie. Those, large values, nulls and values that
    are not finite go through ``F.round``.
    """
    units = value * float(10**digits)
    clear = (F.abs(units) < 1e9) & (F.abs(units - F.rint(units)) < 0.499999)
    return F.when(clear, F.rint(units) / float(10**digits)).otherwise(F.round(value, digits))
