"""Value expressions: every function takes and returns columns, so all of them run inside codegen and on streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DOUBLE = 1.7976931348623157e308


def clip(v: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(F.least(v, high), low)


def unit_range(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low); NULL where the range is empty."""
    return F.try_divide(v - low, high - low)


def signed_range(v: Column, low: Column, high: Column) -> Column:
    return unit_range(v, low, high) * 2 - 1


def nan_to_num(v: Column) -> Column:
    return (
        F.when(F.isnan(v), F.lit(0.0))
        .when(v == F.lit(float("inf")), F.lit(MAX_DOUBLE))
        .when(v == F.lit(float("-inf")), F.lit(-MAX_DOUBLE))
        .otherwise(v)
    )


def unsigned(v: Column, bits: int = 8) -> Column:
    """[0, 1] to an unsigned level, ties to even."""
    return F.rint(clip(v, 0.0, 1.0) * (2**bits - 1)).cast("int")


def single(level: Column, bits: int = 8) -> Column:
    return level / F.lit(float(2**bits - 1))


def tensor_to_level(v: Column) -> Column:
    """[-1, 1] to a byte, truncating."""
    return F.floor((clip(v, -1.0, 1.0) + 1) / 2 * 255).cast("int")


def tensor_to_image(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """[low, high] to a byte, ties to even."""
    return F.rint((clip(v, low, high) - low) / (high - low) * 255).cast("int")


def parse_bool(text: Column) -> Column:
    """yes / true / t / y / 1 and their opposites; anything else is an error."""
    low = F.lower(text)
    return (
        F.when(low.isin("yes", "true", "t", "y", "1"), F.lit(True))
        .when(low.isin("no", "false", "f", "n", "0"), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))
    )
