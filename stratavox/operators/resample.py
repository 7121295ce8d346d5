"""Trilinear resampling of volumes: planes inside Arrow batches, the z axis in chunks with the neighbours they need."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions import kernels
from stratavox.operators import planes
from stratavox.operators.tiling import with_extents

CHUNK_VALUES = 2**20


def _chunk_fn(chunk: pd.DataFrame) -> pd.DataFrame:
    """Linear z interpolation of one output chunk from its input slices."""
    chunk = chunk.sort_values("z")
    first = chunk.iloc[0]
    n, m, span = int(first["nz"]), int(first["mz"]), int(first["_span"])
    start = int(first["_chunk"]) * span
    i = np.arange(start, min(start + span, m))
    low, high, w = kernels.linear_places(i, n, m)
    z = chunk["z"].to_numpy()
    if not (np.isin(low, z).all() and np.isin(high, z).all()):
        raise ValueError(f"volume {first['volume_id']} lacks slices among {low.min()} to {high.max()}")
    block = np.stack(chunk["data"].to_numpy())
    a, b = np.searchsorted(z, low), np.searchsorted(z, high)
    out = block[a] * (1 - w)[:, None] + block[b] * w[:, None]
    return pd.DataFrame(
        {"volume_id": first["volume_id"], "z": i.astype("int32"), "h": first["h"], "w": first["w"], "data": list(out)}
    )


def resample_z(slices: DataFrame, depth: Callable[[Column], Column]) -> DataFrame:
    """Linear resampling along z to ``depth(nz)`` slices.

    The output is cut in chunks of about ``CHUNK_VALUES`` values. An input slice goes to the chunks whose interpolation touches it
    (one or two when enlarging), so the shuffle moves each slice about once and a task holds one chunk.
    """
    sized = with_extents(slices).withColumn("mz", depth(F.col("nz")).cast("int"))
    ratio = F.col("mz") / F.col("nz")
    # Outputs within one input step of slice z; the first and last slices also serve the held ends.
    first = F.when(F.col("z") == 0, F.lit(0)).otherwise(F.greatest(F.floor((F.col("z") - 0.5) * ratio - 0.5), F.lit(0)))
    last = F.when(F.col("z") == F.col("nz") - 1, F.col("mz") - 1).otherwise(
        F.least(F.ceil((F.col("z") + 1.5) * ratio - 0.5), F.col("mz") - 1)
    )
    span = F.least(F.greatest(F.floor(CHUNK_VALUES / (F.col("h") * F.col("w"))), F.lit(4)), F.lit(512)).cast("int")
    sized = sized.withColumn("_span", span)
    chunks = F.sequence(F.floor(first / F.col("_span")).cast("int"), F.floor(last / F.col("_span")).cast("int"))
    spread = sized.where(F.col("mz") > 0).withColumn("_chunk", F.explode(chunks))
    spread = spread.select("volume_id", "_chunk", "_span", "z", "nz", "mz", "h", "w", "data")
    kind = dict(slices.dtypes)["volume_id"]
    schema = f"volume_id {kind}, z int, h int, w int, data array<double>"
    return spread.groupBy("volume_id", "_chunk").applyInPandas(_chunk_fn, schema)


def resample(
    slices: DataFrame,
    scale: tuple[float, float, float] | None = None,
    size: tuple[int, int, int] | None = None,
    cast: str | None = None,
) -> DataFrame:
    """Trilinear: by scale, or to a size where -1 keeps an axis; ``cast`` returns to an integer type by truncation."""
    if (scale is None) == (size is None):
        raise ValueError("give scale or size")

    def target(axis: int, n: int) -> int:
        if scale is not None:
            return int(np.floor(n * scale[axis]))
        return n if size[axis] == -1 else size[axis]

    def plane(block: np.ndarray) -> np.ndarray:
        h, w = block.shape[1:3]
        return planes.separable(
            block, kernels.resize_weights("linear", h, target(1, h)), kernels.resize_weights("linear", w, target(2, w))
        )

    keep_planes = (scale is not None and scale[1:] == (1, 1)) or (size is not None and size[1:] == (-1, -1))
    keep_z = (scale is not None and scale[0] == 1) or (size is not None and size[0] == -1)
    depth = (lambda n: F.floor(n * float(scale[0]))) if scale is not None else (lambda n: F.lit(size[0]))
    # Shrinking planes first makes the z shuffle smaller, enlarging them last does too.
    shrinks = scale is not None and scale[1] * scale[2] < 1
    out = slices
    if not keep_planes and shrinks:
        out = planes.map_planes(out, plane)
    if not keep_z:
        out = resample_z(out, depth)
    if not keep_planes and not shrinks:
        out = planes.map_planes(out, plane)
    return out.withColumn("data", F.transform("data", lambda v: v.cast(cast))) if cast else out


def upsample_to_cube(slices: DataFrame, n: int) -> DataFrame:
    return resample(slices, size=(n, n, n))


def down_up(slices: DataFrame, factor: int) -> DataFrame:
    """Enlarge along z by a factor and return to the old depth."""
    return resample(resample(slices, scale=(factor, 1, 1)), scale=(1 / factor, 1, 1))
