"""Slices -> percentile clip -> rescale -> full patches -> bright patches -> named block rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions import pixel
from stratavox.operators import tiling
from stratavox.operators.layout import slices_to_voxels
from stratavox.operators.normalize import VOLUME, volume_stats
from stratavox.scale import attach_small, exact_quantiles


def rescale_slices(
    slices: DataFrame,
    norm: str | None = "11",
    percentile: Sequence[float] | None = None,
    threshold: Sequence[float] | None = None,
    limit: float = 6.0,
) -> DataFrame:
    """Hard threshold, percentile clip and normalisation on block rows.

    The statistics passes explode values inside the scan stage and shuffle only per-volume summaries;
    the rescale itself is a map over each array, so slices are never shuffled.
    """
    if threshold is not None:
        lo, hi = threshold
        slices = slices.withColumn("data", F.transform("data", lambda v: pixel.clip(v, float(lo), float(hi))))
    if percentile is not None:
        probs = {"p_lo": percentile[0] / 100.0, "p_hi": percentile[1] / 100.0}
        bounds = exact_quantiles(slices_to_voxels(slices), VOLUME, "v", probs).select(*VOLUME, "p_lo", "p_hi")
        low, high = F.col("p_lo"), F.col("p_hi")
        if norm in ("01", "11"):
            # After the clip the extremes are the percentiles themselves: no second statistics pass.
            scale = pixel.unit_range if norm == "01" else pixel.signed_range
            return _map(slices, bounds, lambda v: scale(pixel.clip(v, low, high), low, high))
        slices = _map(slices, bounds, lambda v: pixel.clip(v, low, high))
    if norm in ("01", "11"):
        scale = pixel.unit_range if norm == "01" else pixel.signed_range
        stats = volume_stats(slices_to_voxels(slices))
        return _map(slices, stats, lambda v: scale(v, F.col("v_min"), F.col("v_max")))
    if norm == "zrescale":
        logged = slices.withColumn("data", F.transform("data", lambda v: F.log10(v + 1)))
        stats = volume_stats(slices_to_voxels(logged))
        z = lambda v: pixel.clip(F.try_divide(v - F.col("v_mean"), F.col("v_std")), -limit, limit) / limit
        return _map(logged, stats, z)
    if norm not in (None, "00"):
        raise ValueError(f"unknown normalisation {norm!r}")
    return slices


def _map(slices: DataFrame, stats: DataFrame, fn) -> DataFrame:
    return attach_small(slices, stats, list(VOLUME)).withColumn("data", F.transform("data", fn)).select(*slices.columns)


def mean_of(data: str = "data") -> Column:
    return F.aggregate(data, F.lit(0.0), lambda acc, v: acc + v) / F.size(data)


def prepare_patches(
    channels: Sequence[DataFrame],
    block: Sequence[int],
    norms: Sequence[str | None],
    percentile: Sequence[float] | None = None,
    thresholds: Sequence[Sequence[float] | None] | None = None,
    bright: float = -10.0,
    prefix: str = "",
    limit: float = 6.0,
) -> list[DataFrame]:
    """Aligned patch tables, one per channel; the first channel decides which places stay."""
    thresholds = thresholds or [None] * len(channels)
    cut = [
        tiling.cut_patches(rescale_slices(c, n, percentile, t, limit), block)
        for c, n, t in zip(channels, norms, thresholds)
    ]
    return [tiling.name_patches(p, prefix) for p in tiling.keep_bright(cut[0], bright, cut[1:])]
