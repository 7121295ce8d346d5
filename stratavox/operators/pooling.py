"""Pooling and projection: grouping by integer division, with partial aggregation before the shuffle.

The group key holds the output voxel, so no group grows with the volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.operators.tiling import AXES, with_extents

HOW = {"max": F.max, "min": F.min, "mean": F.avg}


def pool(
    df: DataFrame, kernel: Sequence[int], how: str, value: str = "v", sizes: DataFrame | None = None
) -> DataFrame:
    """Non-overlapping pooling over (kz, kx, ky); an incomplete tail is dropped."""
    out = with_extents(df, sizes)
    keys = [c for c in df.columns if c not in (*AXES, value)]
    for axis, k in zip(AXES, kernel):
        if k > 1:
            out = out.where((F.floor(F.col(axis) / k) + 1) * k <= F.col(f"n{axis}"))
            out = out.withColumn(axis, F.floor(F.col(axis) / k).cast("int"))
    return out.groupBy(*keys, *AXES).agg(HOW[how](value).alias(value))


def project_z(df: DataFrame, depth: int, how: str = "mean", sizes: DataFrame | None = None) -> DataFrame:
    """Reduce non-overlapping z windows; 'min' is a true minimum."""
    return pool(df, (depth, 1, 1), how, sizes=sizes)


def project_z_sampled(df: DataFrame, uprate: int, skip: int) -> DataFrame:
    """Slices ``uprate // 2 :: uprate * skip``."""
    start, step = uprate // 2, uprate * skip
    kept = df.where((F.col("z") >= start) & ((F.col("z") - start) % step == 0))
    return kept.withColumn("z", F.floor((F.col("z") - start) / step).cast("int"))


def adaptive_pool(
    df: DataFrame, bins: dict[str, int], how: str, value: str = "v", sizes: DataFrame | None = None
) -> DataFrame:
    """Pool axes to given sizes; bin i covers floor(i n / m) up to ceil((i + 1) n / m), so bins may share a voxel."""
    out = with_extents(df, sizes)
    keys = [c for c in df.columns if c not in (*AXES, value)]
    for axis, m in bins.items():
        m = F.lit(m) if isinstance(m, int) else m
        n = F.col(f"n{axis}")
        first = F.floor(F.col(axis) * m / n).cast("int")
        last = (F.ceil((F.col(axis) + 1) * m / n) - 1).cast("int")
        out = out.withColumn(axis, F.explode(F.sequence(first, last)))
    return out.groupBy(*keys, *AXES).agg(HOW[how](value).alias(value))


def area_downsample_z(df: DataFrame, step: int, sizes: DataFrame | None = None) -> DataFrame:
    """Mean pooling along z to size // step bins."""
    return adaptive_pool(df, {"z": F.floor(F.col("nz") / step)}, "mean", sizes=sizes)


def mean_flat(df: DataFrame, batch: Sequence[str], value: str = "v") -> DataFrame:
    """Mean over every dimension but the batch keys."""
    return df.groupBy(*batch).agg(F.avg(value).alias("mean"))


def mean_reference(df: DataFrame, value: str = "v") -> DataFrame:
    """Mean over z at each plane position."""
    return df.groupBy("volume_id", "x", "y").agg(F.avg(value).alias(value))
