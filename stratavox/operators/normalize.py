"""Whole-volume intensity operators. Statistics are one narrow row per volume, joined through ``attach_small``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions import pixel
from stratavox.scale import attach_small, exact_quantiles

VOLUME = ("volume_id",)


def volume_stats(df: DataFrame, keys: Sequence[str] = VOLUME, value: str = "v") -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.min(v).alias("v_min"),
        F.max(v).alias("v_max"),
        F.avg(v).alias("v_mean"),
        F.stddev_pop(v).alias("v_std"),
        F.count(v).alias("n"),
    )


def _with_stats(df: DataFrame, keys: Sequence[str], value: str, expr: Column) -> DataFrame:
    joined = attach_small(df, volume_stats(df, keys, value), keys)
    return joined.withColumn(value, expr).select(*df.columns)


def percentile_clip(
    df: DataFrame, low: float, high: float, keys: Sequence[str] = VOLUME, value: str = "v"
) -> DataFrame:
    """Clip to the exact percentiles ``low`` and ``high`` (0-100) of the whole volume."""
    bounds = exact_quantiles(df, keys, value, {"p_lo": low / 100.0, "p_hi": high / 100.0}).select(*keys, "p_lo", "p_hi")
    clipped = pixel.clip(F.col(value), F.col("p_lo"), F.col("p_hi"))
    return attach_small(df, bounds, keys).withColumn(value, clipped).select(*df.columns)


def normalize(df: DataFrame, mode: str | None, keys: Sequence[str] = VOLUME, value: str = "v") -> DataFrame:
    """'01', '11', or '00' / None for no change. A constant volume gives NULL."""
    if mode in (None, "00"):
        return df
    if mode not in ("01", "11"):
        raise ValueError(f"unknown normalisation {mode!r}")
    scale = pixel.unit_range if mode == "01" else pixel.signed_range
    return _with_stats(df, keys, value, scale(F.col(value), F.col("v_min"), F.col("v_max")))


def z_rescale(df: DataFrame, limit: float = 6.0, keys: Sequence[str] = VOLUME, value: str = "v") -> DataFrame:
    logged = df.withColumn(value, F.log10(F.col(value) + 1))
    z = F.try_divide(F.col(value) - F.col("v_mean"), F.col("v_std"))
    return _with_stats(logged, keys, value, pixel.clip(z, -limit, limit) / limit)


def norm_01(df: DataFrame, keys: Sequence[str] = VOLUME, value: str = "v") -> DataFrame:
    """Subtract the minimum, then divide by the new maximum."""
    return _with_stats(df, keys, value, F.try_divide(F.col(value) - F.col("v_min"), F.col("v_max") - F.col("v_min")))


def floor_rescale(df: DataFrame, low: float = -0.85, keys: Sequence[str] = VOLUME, value: str = "v") -> DataFrame:
    return normalize(df.withColumn(value, F.greatest(F.col(value), F.lit(low))), "11", keys, value)


def to_8bit(df: DataFrame, keys: Sequence[str] = VOLUME, value: str = "v") -> DataFrame:
    """Subtract the minimum, scale the maximum to 255, truncate; the gray level fills three channels."""
    joined = attach_small(df, volume_stats(df, keys, value), keys)
    level = F.floor(F.try_divide(F.col(value) - F.col("v_min"), F.col("v_max") - F.col("v_min")) * 255).cast("int")
    rest = [c for c in df.columns if c != value]
    return joined.select(*rest, level.alias("r"), level.alias("g"), level.alias("b"))


def save_range_norm(df: DataFrame, keys: Sequence[str] = VOLUME, value: str = "v") -> DataFrame:
    """Min-max only where the volume leaves [0, 1]."""
    v, low, high = F.col(value), F.col("v_min"), F.col("v_max")
    return _with_stats(df, keys, value, F.when((low < 0) | (high > 1), pixel.unit_range(v, low, high)).otherwise(v))


def profile(df: DataFrame, keys: Sequence[str] = VOLUME, value: str = "v") -> DataFrame:
    """Mean, min, max, median, population deviation and extents per volume."""
    v = F.col(value)
    base = df.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.stddev_pop(v).alias("std"),
        (F.max("z") + 1).alias("nz"),
        (F.max("x") + 1).alias("nx"),
        (F.max("y") + 1).alias("ny"),
    )
    median = exact_quantiles(df, keys, value, {"median": 0.5}).select(*keys, "median")
    return base.join(median, list(keys))


def project_to_rgb(df: DataFrame, matrix: Sequence[Sequence[float]], feature: str = "f") -> DataFrame:
    """Three fixed weighted sums of the channels, scaled to [-1, 1] over the whole table.

    The matrix is 3 x channels, a parameter of the call and not data.
    """
    keep = [c for c in df.columns if c != feature]
    names = ("r", "g", "b")
    mixed = df.select(
        *keep,
        *[
            F.aggregate(
                F.zip_with(F.col(feature), F.array(*[F.lit(float(w)) for w in row]), lambda a, b: a * b),
                F.lit(0.0),
                lambda acc, v: acc + v,
            ).alias(n)
            for n, row in zip(names, matrix)
        ],
    )
    extremes = mixed.agg(F.min(F.least(*names)).alias("v_min"), F.max(F.greatest(*names)).alias("v_max"))
    one = F.lit(1).alias("_one")
    joined = attach_small(mixed.select("*", one), extremes.select("*", one), ["_one"])
    return joined.select(*keep, *[pixel.signed_range(F.col(n), F.col("v_min"), F.col("v_max")).alias(n) for n in names])
