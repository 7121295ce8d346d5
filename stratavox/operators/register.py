"""In-plane registration of slices against a reference plane of their volume."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions import pixel
from stratavox.operators import planes, pooling
from stratavox.operators.layout import slices_to_voxels, voxels_to_slices
from stratavox.scale import attach_small

DIRECT_SIDE = 16


def reference_planes(slices: DataFrame, reference: str | DataFrame = "first") -> DataFrame:
    """One plane per volume: slice 0, the mean over z, or a given table (volume_id, data)."""
    if isinstance(reference, DataFrame):
        return reference.select("volume_id", F.col("data").alias("ref"))
    if reference == "first":
        return slices.where("z = 0").select("volume_id", F.col("data").alias("ref"))
    if reference == "mean":
        means = pooling.mean_reference(slices_to_voxels(slices))
        return voxels_to_slices(means, ["volume_id"]).select("volume_id", F.col("data").alias("ref"))
    raise ValueError("reference is 'first', 'mean' or a table of planes")


def full_correlation(img: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """C[dy, dx] = sum img[y + dy, x + dx] ref[y, x] for every displacement, zero outside; displacement 0 at (h - 1, w - 1)."""
    b, h, w = img.shape
    if max(h, w) > DIRECT_SIDE:
        size = (2 * h - 1, 2 * w - 1)
        spectrum = np.fft.rfft2(img, size) * np.conj(np.fft.rfft2(ref, size))
        return np.roll(np.fft.irfft2(spectrum, size), (h - 1, w - 1), axis=(1, 2))
    wide = np.zeros((b, 3 * h - 2, 3 * w - 2))
    wide[:, h - 1 : 2 * h - 1, w - 1 : 2 * w - 1] = img
    out = np.zeros((b, 2 * h - 1, 2 * w - 1))
    for y in range(h):
        for x in range(w):
            out += wide[:, y : y + 2 * h - 1, x : x + 2 * w - 1] * ref[:, y, x][:, None, None]
    return out


def first_peak(corr: np.ndarray, img: np.ndarray, ref: np.ndarray) -> int:
    """Flat place of the largest correlation, the first of equal ones; peaks that rounding could have parted are summed directly."""
    h, w = img.shape
    flat = corr.ravel()
    slack = 1e-9 * max(float(np.linalg.norm(img) * np.linalg.norm(ref)), 1e-300)
    near = np.flatnonzero(flat >= flat.max() - slack)
    if max(h, w) <= DIRECT_SIDE or len(near) == 1:
        return int(flat.argmax())
    sums = []
    for place in near:
        dy, dx = place // corr.shape[1] - (h - 1), place % corr.shape[1] - (w - 1)
        a = img[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
        b = ref[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
        sums.append(np.cumsum((a * b).ravel())[-1])  # one after the other, as the direct form adds
    return int(near[int(np.argmax(sums))])


def _parabola(corr: np.ndarray, row: int, col: int, axis: int) -> float:
    """Vertex offset of the parabola through a peak and its two neighbours; 0 at the border or on a flat line."""
    at = (row, col)[axis]
    if not 1 <= at < corr.shape[axis] - 1:
        return 0.0
    step = (1, 0) if axis == 0 else (0, 1)
    before, here, after = (corr[row + k * step[0], col + k * step[1]] for k in (-1, 0, 1))
    bend = before - 2 * here + after
    return 0.5 * (before - after) / bend if bend != 0 else 0.0


def _displacements(img: np.ndarray, ref: np.ndarray, subpixel: bool) -> tuple[np.ndarray, np.ndarray]:
    """(dy, dx) of each plane (rows, h, w) against its reference."""
    corr = full_correlation(img, ref)
    best = [first_peak(c, x, y) for c, x, y in zip(corr, img, ref)]
    rows, cols = np.unravel_index(best, corr.shape[1:])
    dy, dx = rows - (img.shape[1] - 1.0), cols - (img.shape[2] - 1.0)
    if subpixel:
        dy += [_parabola(c, r, k, 0) for c, r, k in zip(corr, rows, cols)]
        dx += [_parabola(c, r, k, 1) for c, r, k in zip(corr, rows, cols)]
    return dy, dx


def _beside_references(slices: DataFrame, reference: str | DataFrame) -> DataFrame:
    """Slices with ``img`` and ``ref``, free of NaN. References are attached by a checked join; slices are not shuffled."""
    both = attach_small(slices, reference_planes(slices, reference), ["volume_id"])
    return both.withColumns({"img": F.transform("data", pixel.nan_to_num), "ref": F.transform("ref", pixel.nan_to_num)})


def slice_shifts(slices: DataFrame, reference: str | DataFrame = "first", subpixel: bool = False) -> DataFrame:
    """Displacement (dy, dx) of each slice against the reference: place of the largest correlation, first one on ties."""

    def measure(batch: pd.DataFrame) -> pd.DataFrame:
        dy, dx = np.zeros(len(batch)), np.zeros(len(batch))
        sides = [planes.by_shape(batch[side], batch["h"], batch["w"]) for side in ("img", "ref")]
        for (at, a), (_, b) in zip(*sides):
            dy[at], dx[at] = _displacements(a[..., 0], b[..., 0], subpixel)
        return pd.DataFrame({"dy": dy, "dx": dx})

    ready = _beside_references(slices, reference).select("volume_id", "z", "h", "w", "img", "ref")
    return planes.map_batches(ready, measure, ["h", "w", "img", "ref"], "dy double, dx double")


def align(
    slices: DataFrame,
    reference: str | DataFrame = "first",
    subpixel: bool = False,
    sign: int = -1,
    fill: float = 0.0,
    digits: int | None = None,
) -> DataFrame:
    """Measure and move in one pass over the slices, which are not shuffled; adds nothing and drops nothing.

    ``digits`` rounds the displacement before the move.
    """

    def register(batch: pd.DataFrame) -> pd.DataFrame:
        out: list = [None] * len(batch)
        sides = [planes.by_shape(batch[side], batch["h"], batch["w"]) for side in ("img", "ref", "data")]
        for (at, a), (_, b), (_, block) in zip(*sides):
            dy, dx = _displacements(a[..., 0], b[..., 0], subpixel)
            if digits is not None:
                dy, dx = np.round(dy, digits), np.round(dx, digits)
            for i, flat in zip(at, planes.shifted_block(block, dy, dx, sign, fill).reshape(len(at), -1)):
                out[i] = flat
        return pd.DataFrame({"h": batch["h"], "w": batch["w"], "data": out})

    moved = planes.map_batches(_beside_references(slices, reference), register, ["h", "w", "img", "ref", "data"], planes.PLANE)
    return moved.select(*slices.columns)
