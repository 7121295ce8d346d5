"""Stencils and resampling on block rows: Arrow batches, no shuffle.

A long-form stencil join would emit one row per voxel and kernel tap; here a task applies the same few weights to a
whole batch of equally shaped planes. Planes carry ``h, w, data`` and, for colour, ``channels`` interleaved values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stratavox.functions import draws, kernels
from stratavox.operators.layout import x_windows
from stratavox.scale import attach_small

DIRECT_TAPS = 81
#: About so many bytes of rows, or of what is made of them, are turned into planes at once; of a task's first piece only the rows are known.
PIECE_BYTES = 1 << 20
FIRST_ROWS = 16
PLANE = "h int, w int, data array<double>"
Block = Callable[[np.ndarray], np.ndarray]


def by_shape(data: pd.Series, h: pd.Series, w: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and stacked planes (rows, h, w, channels) of each shape in a batch."""
    shapes = pd.Series(list(zip(h, w)))
    for (hh, ww), rows in shapes.groupby(shapes).groups.items():
        at = rows.to_numpy()
        yield at, np.stack(data.iloc[at].to_numpy()).astype(float).reshape(len(at), hh, ww, -1)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], uses: list[str], makes: str) -> DataFrame:
    """Replace the columns ``uses`` by the columns ``makes`` computed from them, a piece of ``PIECE_BYTES`` at a time.

    This is an operator of its own in the plan. A function column would be copied into every later
    expression that reads its result, and run once per copy. ``fn`` gets rows of about ``PIECE_BYTES`` in all, one at least, and fewer
    if the piece before grew, so what it makes of them takes the same memory however many rows an Arrow batch has. Other columns stay as they are.
    """
    keep = [c for c in df.columns if c not in uses]
    made = T.StructType.fromDDL(makes)
    schema = T.StructType([*(df.schema[c] for c in keep), *made])
    kinds = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, grown = FIRST_ROWS, 0
        for batch in batches:
            row, begin = batch.nbytes // max(batch.num_rows, 1), 0
            while begin < batch.num_rows:
                piece = batch.slice(begin, max(1, min(most, PIECE_BYTES // max(row, grown, 1))))
                out = fn(piece.select(uses).to_pandas())
                new = [pa.Array.from_pandas(out[f.name], type=f.type) for f in kinds]
                begin, most, grown = begin + piece.num_rows, batch.num_rows, sum(a.nbytes for a in new) // piece.num_rows
                yield pa.RecordBatch.from_arrays([*(piece[c] for c in keep), *new], [*keep, *kinds.names])

    return df.select(*keep, *uses).mapInArrow(run, schema)


def map_planes(df: DataFrame, fn: Block) -> DataFrame:
    """Apply ``fn`` (rows, h, w, channels) -> (rows, h2, w2, channels2) to every plane."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out_h, out_w = np.zeros(len(batch), dtype=int), np.zeros(len(batch), dtype=int)
        out: list = [None] * len(batch)
        for at, block in by_shape(batch["data"], batch["h"], batch["w"]):
            result = fn(block)
            out_h[at], out_w[at] = result.shape[1], result.shape[2]
            for i, flat in zip(at, result.reshape(len(at), -1)):
                out[i] = flat
        return pd.DataFrame({"h": out_h, "w": out_w, "data": out})

    return map_batches(df, run, ["h", "w", "data"], PLANE)


def separable(block: np.ndarray, rows: kernels.Taps, cols: kernels.Taps) -> np.ndarray:
    """Weights along rows then columns of (planes, h, w, channels)."""
    return cols.along(rows.along(block, 1), 2)


def take_padded(block: np.ndarray, top: int, bottom: int, left: int, right: int, mode: str) -> np.ndarray:
    h, w = block.shape[1:3]
    rows = kernels.border_index(np.arange(-top, h + bottom), h, mode)
    cols = kernels.border_index(np.arange(-left, w + right), w, mode)
    out = block[:, np.maximum(rows, 0)][:, :, np.maximum(cols, 0)]
    if mode == "zero":
        out = out * (rows >= 0)[None, :, None, None] * (cols >= 0)[None, None, :, None]
    return out


def correlate(block: np.ndarray, kernel: np.ndarray, mode: str, stride: int = 1, flip: bool = False) -> np.ndarray:
    """Weighted sum over a window; ``flip`` turns it into a convolution.

    The centre is size // 2 for a convolution and (size - 1) // 2 for a correlation.
    """
    kh, kw = kernel.shape
    if flip:
        kernel = kernel[::-1, ::-1]
        top, left = kh - 1 - kh // 2, kw - 1 - kw // 2
    else:
        top, left = (kh - 1) // 2, (kw - 1) // 2
    h, w = block.shape[1:3]
    wide = take_padded(block, top, kh - 1 - top, left, kw - 1 - left, mode)
    if kernel.size > DIRECT_TAPS:
        spectrum = np.fft.rfft2(wide, axes=(1, 2))
        window = np.conj(np.fft.rfft2(kernel, wide.shape[1:3]))[None, :, :, None]
        full = np.fft.irfft2(spectrum * window, wide.shape[1:3], axes=(1, 2))
        return full[:, :h:stride, :w:stride]
    out = np.zeros_like(block[:, ::stride, ::stride])
    for (y, x), weight in np.ndenumerate(kernel):
        if weight:
            out += weight * wide[:, y : y + h : stride, x : x + w : stride]
    return out


def pad(df: DataFrame, p: int, mode: str) -> DataFrame:
    return map_planes(df, lambda b: take_padded(b, p, p, p, p, mode))


def convolve(df: DataFrame, kernel: np.ndarray, border: str) -> DataFrame:
    return map_planes(df, lambda b: correlate(b, kernel, border, flip=True))


def blur(df: DataFrame, kernel: np.ndarray) -> DataFrame:
    """Cross-correlation with repeated edges."""
    return map_planes(df, lambda b: correlate(b, kernel, "replicate"))


def blur_downsample(df: DataFrame, taps: int = 3, border: str = "reflect", stride: int = 2) -> DataFrame:
    """Binomial smoothing and striding in one pass."""
    return map_planes(df, lambda b: correlate(b, kernels.binomial(taps), border, stride))


def resize(df: DataFrame, method: str, size: tuple[int, int] | None = None, factor: float | None = None, align_corners: bool = False) -> DataFrame:
    """To a fixed size, or to floor(length * factor)."""

    def fn(block: np.ndarray) -> np.ndarray:
        h, w = block.shape[1:3]
        m_h, m_w = size or (int(h * factor), int(w * factor))
        return separable(
            block,
            kernels.resize_weights(method, h, m_h, None, align_corners),
            kernels.resize_weights(method, w, m_w, None, align_corners),
        )

    return map_planes(df, fn)


def resize_rounded(df: DataFrame, method: str, factor: float) -> DataFrame:
    """Sizes round(length * factor)."""

    def fn(block: np.ndarray) -> np.ndarray:
        h, w = block.shape[1:3]
        rows, cols = (kernels.resize_weights(method, n, round(n * factor)) for n in (h, w))
        return separable(block, rows, cols)

    return map_planes(df, fn)


def resize_stages(df: DataFrame, method: str, multiplier: float, stages: int) -> DataFrame:
    """Repeat a rescale; methods nearest, linear (bilinear), cubic, area."""
    for _ in range(stages):
        df = resize(df, method, factor=multiplier)
    return df


def resize_and_stack(images: DataFrame, low: DataFrame, method: str = "linear") -> DataFrame:
    """The image of ``low`` with the same (volume_id, z), resized to the size of the image and put behind its channels.

    Values interleave channels, so an image of a and one of b channels give a + b values per pixel. Rows without a partner go.
    """
    keys = ["volume_id", "z"]
    right = low.select(*keys, F.col("h").alias("_lh"), F.col("w").alias("_lw"), F.col("data").alias("_low"))
    both = images.select(*keys, "h", "w", "data").join(right, keys)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out: list = [None] * len(batch)
        for at, block in by_shape(batch["data"], batch["h"], batch["w"]):
            h, w = block.shape[1:3]
            part = batch.iloc[at].reset_index(drop=True)
            for inner, small in by_shape(part["_low"], part["_lh"], part["_lw"]):
                rows, cols = kernels.resize_weights(method, small.shape[1], h), kernels.resize_weights(method, small.shape[2], w)
                stacked = np.concatenate([block[inner], separable(small, rows, cols)], axis=3)
                for i, flat in zip(at[inner], stacked.reshape(len(inner), -1)):
                    out[i] = flat
        return pd.DataFrame({"h": batch["h"], "w": batch["w"], "data": out})

    return map_batches(both, run, ["h", "w", "data", "_lh", "_lw", "_low"], PLANE)


def matlab_block(block: np.ndarray, scale: float) -> np.ndarray:
    """Bicubic, widened when shrinking, output length ceil(length * scale)."""
    h, w = block.shape[1:3]
    rows = kernels.resize_weights("matlab", h, int(np.ceil(h * scale)), scale)
    cols = kernels.resize_weights("matlab", w, int(np.ceil(w * scale)), scale)
    return separable(block, rows, cols)


def resize_bicubic_aa(df: DataFrame, scale: float) -> DataFrame:
    return map_planes(df, lambda b: matlab_block(b, scale))


def resize_nearest_labels(df: DataFrame, size: tuple[int, int]) -> DataFrame:
    return resize(df, "nearest", size)


def resize_square(df: DataFrame, n: int = 0, name: str = "z") -> DataFrame:
    """To n x n, linear; 0 takes the width of the first image by name."""
    if n:
        return resize(df, "linear", (n, n))
    first = df.agg(F.min_by("w", F.col(name)).alias("n")).head()["n"]
    return resize(df, "linear", (first, first))


def resize_short_side(df: DataFrame, n: int) -> DataFrame:
    """Short side n, aspect kept, cubic."""

    def fn(block: np.ndarray) -> np.ndarray:
        h, w = block.shape[1:3]
        m_h, m_w = (n, int(w * n / h)) if h <= w else (int(h * n / w), n)
        return separable(block, kernels.resize_weights("cubic", h, m_h), kernels.resize_weights("cubic", w, m_w))

    return map_planes(df, fn)


def drawn_batch_size(batch: Column, low: int, high: int, seed: int) -> Column:
    """Size of a whole batch: low, low + 16 ... high by draw; the first five batches take the largest."""
    steps = (high - low) // 16 + 1
    drawn = F.lit(low) + 16 * draws.integer(seed, "batchsize", 0, steps, batch)
    return F.when(batch <= 4, F.lit(high)).otherwise(drawn)


def batch_resize(df: DataFrame, batch: Column, low: int, high: int, seed: int) -> DataFrame:
    """Gray to three channels, then cubic to the size drawn for the batch."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list = [None] * len(rows)
        for (h, w, n), part in rows.groupby(["h", "w", "_n"]):
            block = np.stack(part["data"].to_numpy()).astype(float).reshape(len(part), h, w, 1)
            block = np.repeat(block, 3, axis=3)
            if (n, n) != (h, w):
                block = separable(block, kernels.resize_weights("cubic", h, n), kernels.resize_weights("cubic", w, n))
            for i, flat in zip(part.index, block.reshape(len(part), -1)):
                out[i] = flat
        return pd.DataFrame({"h": rows["_n"], "w": rows["_n"], "data": out})

    sized = df.withColumn("_n", drawn_batch_size(batch, low, high, seed))
    return map_batches(sized, run, ["h", "w", "data", "_n"], PLANE)


def pyramid_pool(df: DataFrame, levels: tuple[int, ...] = (1, 2, 3, 6)) -> DataFrame:
    """Adds p1, p2, p3, p6: the plane pooled to so many cells per side and brought back linearly, next to the input."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = {f"p{n}": [None] * len(batch) for n in levels}
        for at, block in by_shape(batch["data"], batch["h"], batch["w"]):
            h, w = block.shape[1:3]
            for n in levels:
                pool_h, pool_w = kernels.pool_weights(h, h // n), kernels.pool_weights(w, w // n)
                rows = kernels.resize_weights("linear", pool_h.m, h)
                cols = kernels.resize_weights("linear", pool_w.m, w)
                back = separable(separable(block, pool_h, pool_w), rows, cols)
                for i, flat in zip(at, back.reshape(len(at), -1)):
                    out[f"p{n}"][i] = flat
        return pd.concat([batch, pd.DataFrame(out)], axis=1)

    made = ", ".join(f"p{n} array<double>" for n in levels)
    return map_batches(df, run, ["h", "w", "data"], f"{PLANE}, {made}")


def shift_pixel(df: DataFrame, scale: int, upper_left: bool = True) -> DataFrame:
    offset = (scale - 1) * 0.5 * (1 if upper_left else -1)
    return map_planes(df, lambda b: separable(b, kernels.shift_weights(b.shape[1], offset), kernels.shift_weights(b.shape[2], offset)))


def _place(block: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float | None) -> np.ndarray:
    """Bilinear values at (rows, h, w) coordinates; outside is reflected (fill None) or constant."""
    b, h, w, _ = block.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    at = np.arange(b)[:, None, None]
    out = np.zeros((*y.shape, block.shape[3]))
    for dy in (0, 1):
        for dx in (0, 1):
            weight = (np.where(dy, y - y0, 1 - (y - y0)) * np.where(dx, x - x0, 1 - (x - x0)))[..., None]
            rows, cols = kernels.border_index(y0 + dy, h, "reflect"), kernels.border_index(x0 + dx, w, "reflect")
            out += weight * block[at, rows, cols]
    if fill is not None:
        inside = (y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1)
        out = np.where(inside[..., None], out, fill)
    return out


def shifted_block(block: np.ndarray, dy: np.ndarray, dx: np.ndarray, sign: int = -1, fill: float = 0.0) -> np.ndarray:
    """Planes (rows, h, w, channels), each moved by sign * (dy, dx) of its own."""
    h, w = block.shape[1:3]
    y, x = np.meshgrid(np.arange(h, dtype=float), np.arange(w, dtype=float), indexing="ij")
    return _place(block, y[None] - sign * dy[:, None, None], x[None] - sign * dx[:, None, None], fill)


def _moved(df: DataFrame, params: list[Column], coords, fill: float | None) -> DataFrame:
    """Inverse mapping with per-row parameters."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out: list = [None] * len(batch)
        table = np.stack(batch["_move"].to_numpy()).astype(float)
        for at, block in by_shape(batch["data"], batch["h"], batch["w"]):
            hh, ww = block.shape[1:3]
            grid_y, grid_x = np.meshgrid(np.arange(hh), np.arange(ww), indexing="ij")
            p = [table[at, i][:, None, None] for i in range(table.shape[1])]
            y, x = coords(grid_y[None].astype(float), grid_x[None].astype(float), hh, ww, *p)
            for i, flat in zip(at, _place(block, y, x, fill).reshape(len(at), -1)):
                out[i] = flat
        return pd.DataFrame({"h": batch["h"], "w": batch["w"], "data": out})

    moved = df.withColumn("_move", F.array(*[p.cast("double") for p in params]))
    return map_batches(moved, run, ["h", "w", "data", "_move"], PLANE)


def rotate(df: DataFrame, seed: int, limit: float = 45.0, sample: str = "volume_id") -> DataFrame:
    """Turn about the centre by an angle drawn per sample in +-limit degrees; outside pixels are reflected without the edge."""
    angle = F.radians((draws.uniform(seed, "angle", F.col(sample)) * 2 - 1) * limit)

    def coords(y, x, h, w, a):
        cy, cx = (h - 1) / 2, (w - 1) / 2
        dy, dx = y - cy, x - cx
        return cy + dy * np.cos(a) + dx * np.sin(a), cx - dy * np.sin(a) + dx * np.cos(a)

    return _moved(df, [angle], coords, None)


def apply_shift(df: DataFrame, shifts: DataFrame | None = None, sign: int = -1, fill: float = 0.0, cast: str | None = None) -> DataFrame:
    """Move planes by sign * (dy, dx) with linear interpolation and a constant outside.

    The default undoes a measured displacement; +1 adds it.
    """
    moved = df if shifts is None else attach_small(df, shifts, ["volume_id", "z"])
    out = _moved(
        moved,
        [F.col("dy"), F.col("dx")],
        lambda y, x, h, w, dy, dx: (y - sign * dy + 0 * x, x - sign * dx + 0 * y),
        fill,
    )
    out = out.withColumn("data", F.transform("data", lambda v: v.cast(cast))) if cast else out
    return out.select(*df.columns)


def sharpen(df: DataFrame, weight: float = 0.5, radius: int = 50, threshold: float = 10.0) -> DataFrame:
    """Unsharp mask where the detail exceeds the threshold, blended by the blurred mask."""
    return map_planes(df, lambda b: sharpen_block(b, weight, radius, threshold))


def sharpen_block(block: np.ndarray, weight: float = 0.5, radius: int = 50, threshold: float = 10.0) -> np.ndarray:
    size = radius + 1 if radius % 2 == 0 else radius
    # Width of the smoothing window for a given size.
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    taps = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    taps = taps / taps.sum()

    def smooth(b: np.ndarray) -> np.ndarray:
        h, w = b.shape[1:3]
        reach = np.arange(size) - size // 2
        rows, cols = (
            kernels.make_taps(n, np.arange(n)[:, None] + reach, np.tile(taps, (n, 1)), "mirror") for n in (h, w)
        )
        return separable(b, rows, cols)

    residual = block - smooth(block)
    mask = smooth((np.abs(residual) * 255 > threshold).astype(float))
    return mask * np.clip(block + weight * residual, 0, 1) + (1 - mask) * block


def _window_taps(size: int, sigma: float) -> np.ndarray:
    taps = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma * sigma))
    return taps / taps.sum()


def _valid(n: int, taps: np.ndarray) -> kernels.Taps:
    m = n - len(taps) + 1
    return kernels.make_taps(n, np.arange(m)[:, None] + np.arange(len(taps)), np.tile(taps, (m, 1)), "zero")


def ssim_maps(a: np.ndarray, b: np.ndarray, taps: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarity and contrast maps over the valid area of a smoothing window."""
    rows, cols = _valid(a.shape[1], taps), _valid(a.shape[2], taps)
    ma, mb, aa, bb, ab = (separable(v, rows, cols) for v in (a, b, a * a, b * b, a * b))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    contrast = (2 * (ab - ma * mb) + c2) / (aa - ma * ma + bb - mb * mb + c2)
    return (2 * ma * mb + c1) / (ma * ma + mb * mb + c1) * contrast, contrast


def ssim(pairs: DataFrame, border: int = 0) -> DataFrame:
    """Adds ``ssim`` to block-row pairs (a, b, h, w) of [0, 255] levels; colour is the mean over channels."""

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inner = slice(border, -border or None)
        return ssim_maps(a[:, inner, inner], b[:, inner, inner], _window_taps(11, 1.5), 255.0)[0].mean(axis=(1, 2, 3))

    return _pair_score(pairs, score, "ssim")


# Weights of the three scales.
MS_WEIGHTS = (0.0448, 0.2856, 0.6696)


def ms_ssim(pairs: DataFrame, win: int = 7, span: float = 2.0, weights: tuple[float, ...] = MS_WEIGHTS) -> DataFrame:
    """Adds ``ms_ssim``: contrast at the finer scales times similarity at the coarsest, each to its weight."""

    def half(b: np.ndarray) -> np.ndarray:
        return separable(b, _half(b.shape[1]), _half(b.shape[2]))

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        taps, product = _window_taps(win, 1.5), 1.0
        for level, weight in enumerate(weights):
            similarity, contrast = ssim_maps(a, b, taps, span)
            last = level == len(weights) - 1
            value = (similarity if last else contrast).mean(axis=(1, 2))
            product = product * np.maximum(value, 0.0) ** weight
            if not last:
                a, b = half(a), half(b)
        return product.mean(axis=1)

    return _pair_score(pairs, score, "ms_ssim")


class Part:
    """Rows [low, low + len) of a plane of ``height`` rows, as (planes, rows, columns, channels)."""

    def __init__(self, block: np.ndarray, low: int, height: int):
        self.block, self.low, self.height = block, low, height

    def rows(self, begin: int, end: int) -> np.ndarray:
        return self.block[:, begin - self.low : end - self.low]

    def half(self) -> Part:
        """2 x 2 means as in ``_half``: of an odd height, a zero row before and after counts."""
        odd, high = self.height % 2, self.low + self.block.shape[1]
        height = (self.height + 2 * odd - 2) // 2 + 1
        begin = -(-(self.low + odd) // 2) if self.low else 0
        end = (high + odd) // 2 if high < self.height else height
        end = max(end, begin)
        need = np.arange(2 * begin - odd, 2 * end - odd)
        inside = (need >= 0) & (need < self.height)
        pairs = self.block[:, np.where(inside, need - self.low, 0)] * inside[None, :, None, None]
        means = pairs.reshape(len(pairs), end - begin, 2, *pairs.shape[2:]).mean(axis=2)
        return Part(_half(means.shape[2]).along(means, 2), begin, height)


def ms_ssim_depth(
    pairs: DataFrame,
    win: int = 7,
    span: float = 2.0,
    weights: tuple[float, ...] = MS_WEIGHTS,
    rows: int = 256,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``ms_ssim`` of the (Z, Y) planes of two volumes, per (volume_id, x), for volumes of any depth.

    ``pairs``: aligned slices (volume_id, z, h, w, a, b). A plane is scored in windows of ``rows`` slices: a window owns the
    positions of each scale that begin in it and has the neighbours that their smoothing and halving reach: smoothing reaches
    up only, so below a window those of halving suffice. Sums and counts
    of the windows are added up per plane, so the score does not depend on ``rows``. A plane smaller than the smoothing window at some scale
    has no score (NULL).
    """
    levels = len(weights)
    parts = x_windows(pairs, rows, (win + 1) << (levels - 1), ("a", "b"), sizes, before=2 << (levels - 1))
    names = [f"{kind}{level}" for level in range(levels) for kind in ("s", "n")]

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(batch), len(names)))
        taps = _window_taps(win, 1.5)
        for (h, w, low, window, nz), at in batch.groupby(["h", "w", "z_from", "window", "nz"]).indices.items():
            a, b = (Part(np.stack(batch[side].iloc[at].to_numpy()).astype(float).reshape(len(at), h, w, 1), low, nz) for side in ("a", "b"))
            for level in range(levels):
                first, beyond = (-(-min(edge, nz) // (1 << level)) for edge in (window * rows, (window + 1) * rows))
                beyond = min(beyond, a.height - win + 1)
                if beyond > first and a.block.shape[2] >= win:
                    similarity, contrast = ssim_maps(a.rows(first, beyond + win - 1), b.rows(first, beyond + win - 1), taps, span)
                    value = similarity if level == levels - 1 else contrast
                    out[at, 2 * level], out[at, 2 * level + 1] = value.sum(axis=(1, 2, 3)), value[0].size
                if level < levels - 1:
                    a, b = a.half(), b.half()
        return pd.DataFrame(out, columns=names)

    uses = ["h", "w", "z_from", "window", "nz", "a", "b"]
    scored = map_batches(parts, run, uses, ", ".join(f"{n} double" for n in names))
    sums = scored.groupBy("volume_id", "x").agg(*[F.sum(n).alias(n) for n in names])
    factors = [F.pow(F.greatest(F.try_divide(F.col(f"s{k}"), F.col(f"n{k}")), F.lit(0.0)), F.lit(weight)) for k, weight in enumerate(weights)]
    missing = reduce(lambda x, y: x | y, [F.col(f"n{k}") == 0 for k in range(levels)])
    return sums.select("volume_id", "x", F.when(~missing, reduce(lambda x, y: x * y, factors)).alias("ms_ssim"))


def _half(n: int) -> kernels.Taps:
    """2-wide mean pooling; an odd length is padded by one zero on both sides, counted in the mean."""
    odd = n % 2
    m = (n + 2 * odd - 2) // 2 + 1
    return kernels.make_taps(n, 2 * np.arange(m)[:, None] - odd + np.arange(2), np.full((m, 2), 0.5), "zero")


def _pair_score(pairs: DataFrame, score, name: str) -> DataFrame:
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(batch))
        sides = [by_shape(batch[side], batch["h"], batch["w"]) for side in ("a", "b")]
        for (at, left), (_, right) in zip(*sides):
            out[at] = score(left, right)
        return pd.DataFrame({name: out})

    return map_batches(pairs, run, ["h", "w", "a", "b"], f"{name} double")
