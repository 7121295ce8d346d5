"""Separable multi-level filter bank on block rows, its inverse, and coefficient arithmetic."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions import kernels
from stratavox.operators.planes import PLANE, by_shape, map_batches

COEFFICIENTS = "level int, m1 int, m2 int, h int, w int, data array<double>"


def analysis_weights(mask: Sequence[float], n: int) -> np.ndarray:
    """Filter with zero borders, then keep every second place (from 1 for even mask lengths, else from 0)."""
    mask = np.asarray(mask, dtype=float)
    size = len(mask)
    ends = np.arange((size + 1) % 2, n + size - 1, 2)
    taps = ends[:, None] - size + 1 + np.arange(size)
    return kernels.make_taps(n, taps, np.tile(mask, (len(ends), 1)), "zero").dense()


def dwt2(slices: DataFrame, masks: Sequence[Sequence[float]], levels: int) -> DataFrame:
    """One row per image, level and mask pair; the finest approximation is not kept."""
    keys, kinds = ["volume_id", "z"], dict(slices.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            for at, block in by_shape(batch["data"], batch["h"], batch["w"]):
                approx = block[..., 0]
                for level in range(1, levels + 1):
                    rows = [analysis_weights(m, approx.shape[1]) for m in masks]
                    cols = [analysis_weights(m, approx.shape[2]) for m in masks]
                    following = None
                    for m1, left in enumerate(rows):
                        for m2, right in enumerate(cols):
                            c = 2 * (left @ approx @ right.T)
                            following = c if following is None else following
                            frame = batch.loc[at, keys].copy()
                            frame["level"], frame["m1"], frame["m2"] = level, m1, m2
                            frame["h"], frame["w"] = c.shape[1:]
                            frame["data"] = list(c.reshape(len(at), -1))
                            yield frame
                    approx = following

    return slices.select(*keys, "h", "w", "data").mapInPandas(run, f"volume_id {kinds['volume_id']}, z {kinds['z']}, {COEFFICIENTS}")


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Add or subtract coefficient tables place by place; a missing side counts as zero."""
    keys = ["volume_id", "z", "level", "m1", "m2"]
    sign = {"+": 1.0, "-": -1.0}[op]
    left = a.select(*keys, F.struct("h", "w", "data").alias("l"))
    right = b.select(*keys, F.struct("h", "w", "data").alias("r"))
    both = left.join(right, keys, "full_outer")
    size = F.coalesce(F.size("l.data"), F.size("r.data"))
    zeros = F.array_repeat(F.lit(0.0), size)
    unlike = F.col("l").isNotNull() & F.col("r").isNotNull() & ((F.col("l.h") != F.col("r.h")) | (F.col("l.w") != F.col("r.w")))
    data = F.zip_with(
        F.coalesce("l.data", zeros), F.coalesce("r.data", zeros), lambda x, y: x + F.lit(sign) * y
    )
    data = F.when(unlike, F.raise_error(F.lit("coefficient tables of unlike sizes")).cast("array<double>")).otherwise(data)
    return both.select(
        *keys, F.coalesce("l.h", "r.h").alias("h"), F.coalesce("l.w", "r.w").alias("w"), data.alias("data")
    )


def scale(a: DataFrame, op: str, factor: float) -> DataFrame:
    value = factor if op == "*" else 1.0 / factor
    return a.withColumn("data", F.transform("data", lambda v: v * F.lit(float(value))))


def invdwt2(coefficients: DataFrame, masks: Sequence[Sequence[float]], levels: int, size: tuple[int, int]) -> DataFrame:
    """Rebuild the images; a row gathers the coefficients of one image."""
    sizes = [size]
    for _ in range(levels):
        sizes.append(tuple(len(analysis_weights(masks[0], n)) for n in sizes[-1]))

    n = len(masks)
    wanted = [(level, m1, m2) for level in range(1, levels + 1) for m1 in range(n) for m2 in range(n)]
    at = F.struct("level", "m1", "m2")
    wide = coefficients.groupBy("volume_id", "z").agg(
        *[
            F.first(F.when(at == F.struct(*[F.lit(i) for i in spot]), F.col("data")), ignorenulls=True).alias("c%d_%d_%d" % spot)
            for spot in wanted
        ]
    )

    def rebuild(batch: pd.DataFrame) -> pd.DataFrame:
        def part(level: int, m1: int, m2: int) -> np.ndarray:
            return np.stack(batch["c%d_%d_%d" % (level, m1, m2)].to_numpy()).reshape(len(batch), *sizes[level])

        approx = part(levels, 0, 0)
        for level in range(levels, 0, -1):
            n_h, n_w = sizes[level - 1]
            total = np.zeros((len(batch), n_h, n_w))
            for m1, left in enumerate(masks):
                for m2, right in enumerate(masks):
                    c = approx if m1 == m2 == 0 else part(level, m1, m2)
                    rows, cols = analysis_weights(left, n_h), analysis_weights(right, n_w)
                    total += 2 * (rows.T @ c @ cols)
            approx = total
        flat = list(approx.reshape(len(batch), -1))
        return pd.DataFrame({"h": size[0], "w": size[1], "data": flat})

    return map_batches(wide, rebuild, ["c%d_%d_%d" % spot for spot in wanted], PLANE)
