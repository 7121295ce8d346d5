"""Small numeric tables: border rules, 1-D resampling weights and blur kernels.

Everything here depends on sizes and parameters only. Tasks build the tables they need (a few hundred numbers) and
apply them to Arrow batches of block rows.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

SMALL_MATRIX = 4096


def border_index(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Source index for any position; -1 stands for a zero outside the image."""
    i = np.asarray(i)
    if mode == "wrap":
        return i % n
    if mode == "replicate":
        return np.clip(i, 0, n - 1)
    if mode in ("mirror", "reflect"):
        if n == 1:
            return np.zeros_like(i)
        j = i % (2 * (n - 1))
        return np.where(j < n, j, 2 * (n - 1) - j)
    if mode == "symmetric":
        j = i % (2 * n)
        return np.where(j < n, j, 2 * n - 1 - j)
    if mode == "zero":
        return np.where((i < 0) | (i >= n), -1, i)
    raise ValueError(f"unknown border {mode!r}")


class Taps(NamedTuple):
    """Few weights per output place: source ``index`` (m x k), ``weight`` (m x k), source length ``n``."""

    index: np.ndarray
    weight: np.ndarray
    n: int

    @property
    def m(self) -> int:
        return len(self.index)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.m, self.n))
        rows = np.repeat(np.arange(self.m), self.index.shape[1])
        np.add.at(out, (rows, self.index.ravel()), self.weight.ravel())
        return out

    def along(self, block: np.ndarray, axis: int) -> np.ndarray:
        """Apply to one axis: a small matrix product for short axes, a sum over the taps for long ones."""
        if self.m * self.n <= SMALL_MATRIX:
            return np.moveaxis(np.tensordot(self.dense(), block, axes=(1, axis)), 0, axis)
        shape = [1] * block.ndim
        shape[axis] = self.m
        total = 0.0
        for t in range(self.index.shape[1]):
            total = total + self.weight[:, t].reshape(shape) * np.take(block, self.index[:, t], axis=axis)
        return total


def make_taps(n: int, places: np.ndarray, weights: np.ndarray, mode: str) -> Taps:
    """Taps from unbounded positions under a border rule."""
    index = border_index(places, n, mode)
    return Taps(np.maximum(index, 0), np.where(index < 0, 0.0, weights), n)


def linear_places(i: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower tap, upper tap and upper weight of output positions i when n samples become m (pixel centres aligned)."""
    u = np.maximum((np.asarray(i) + 0.5) * n / m - 0.5, 0.0)
    low = np.minimum(np.floor(u).astype(int), n - 1)
    return low, np.minimum(low + 1, n - 1), u - low


def _cubic(t: np.ndarray, a: float) -> np.ndarray:
    """Two-piece cubic convolution kernel with free parameter a."""
    t = np.abs(t)
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = a * (((t - 5) * t + 8) * t - 4)
    return np.where(t <= 1, near, np.where(t < 2, far, 0.0))


@lru_cache(maxsize=256)
def resize_weights(method: str, n: int, m: int, scale: float | None = None, align_corners: bool = False) -> Taps:
    """Weights that resample n samples to m.

    'nearest', 'linear', 'area' (integer bins, overlapping if needed), 'coverage' (fractional bins), 'cubic' (a = -3/4, edge
    repeated), 'matlab' (a = -1/2, widened when shrinking, symmetric border).
    """
    i = np.arange(m)
    if method == "nearest":
        return make_taps(n, np.minimum(i * n // m, n - 1)[:, None], np.ones((m, 1)), "replicate")
    if method == "linear":
        if align_corners:
            u = i * ((n - 1) / (m - 1) if m > 1 else 0.0)
            low = np.floor(u).astype(int)
            taps = np.stack([low, np.minimum(low + 1, n - 1)], 1)
            return make_taps(n, taps, np.stack([1 - (u - low), u - low], 1), "replicate")
        low, high, w = linear_places(i, n, m)
        return make_taps(n, np.stack([low, high], 1), np.stack([1 - w, w], 1), "replicate")
    if method == "area":
        first, stop = i * n // m, -(-(i + 1) * n // m)
        places = first[:, None] + np.arange((stop - first).max())
        inside = places < stop[:, None]
        return make_taps(n, places, inside / inside.sum(1, keepdims=True), "replicate")
    if method == "coverage":
        if m >= n:
            return resize_weights("linear", n, m)
        low, high = (i * n / m)[:, None], ((i + 1) * n / m)[:, None]
        places = np.floor(low).astype(int) + np.arange(int(np.ceil(n / m)) + 1)
        cover = np.clip(np.minimum(high, places + 1) - np.maximum(low, places), 0, None) * (places < n)
        return make_taps(n, places, cover / cover.sum(1, keepdims=True), "replicate")
    if method == "cubic":
        u = i * ((n - 1) / (m - 1) if m > 1 else 0.0) if align_corners else (i + 0.5) * n / m - 0.5
        low = np.floor(u).astype(int)
        taps = low[:, None] + np.arange(-1, 3)[None, :]
        return make_taps(n, taps, _cubic(u[:, None] - taps, -0.75), "replicate")
    if method == "matlab":
        s = m / n if scale is None else scale
        shrink = min(s, 1.0)
        u = (i + 1) / s + 0.5 * (1 - 1 / s)
        width = 4 / shrink
        first = np.floor(u - width / 2)
        taps = first[:, None] + np.arange(int(np.ceil(width)) + 2)[None, :]
        weights = shrink * _cubic(shrink * (u[:, None] - taps), -0.5)
        weights = weights / weights.sum(1, keepdims=True)
        return make_taps(n, taps.astype(int) - 1, weights, "symmetric")
    raise ValueError(f"unknown resize method {method!r}")


def shift_weights(n: int, offset: float) -> Taps:
    """Linear interpolation at positions i + offset, held inside the image."""
    u = np.clip(np.arange(n) + offset, 0, n - 1)
    low = np.floor(u).astype(int)
    taps = np.stack([low, np.minimum(low + 1, n - 1)], 1)
    return make_taps(n, taps, np.stack([1 - (u - low), u - low], 1), "replicate")


def pool_weights(n: int, kernel: int) -> Taps:
    m = n // kernel
    places = (np.arange(m) * kernel)[:, None] + np.arange(kernel)
    return make_taps(n, places, np.full((m, kernel), 1 / kernel), "replicate")


def isotropic_gaussian(size: int, sigma: float) -> np.ndarray:
    axis = np.arange(size) - (size - 1) / 2
    k = np.exp(-(axis[:, None] ** 2 + axis[None, :] ** 2) / (2 * sigma * sigma))
    k[k < np.finfo(float).eps * k.max()] = 0
    return k / k.sum() if k.sum() else k


def anisotropic_gaussian(size: int, theta: float, l1: float, l2: float) -> np.ndarray:
    """Covariance with eigenvalues l1 (along angle theta) and l2."""
    along = np.array([np.cos(theta), np.sin(theta)])
    across = np.array([np.sin(theta), -np.cos(theta)])
    inverse = np.linalg.inv(l1 * np.outer(along, along) + l2 * np.outer(across, across))
    axis = np.arange(size) - size / 2 + 0.5
    grid = np.stack(np.meshgrid(axis, axis), -1)
    k = np.exp(-0.5 * np.einsum("...i,ij,...j->...", grid, inverse, grid))
    return k / k.sum()


def random_gaussian(
    size: int, scale: int, u: tuple[float, float, float], low: float = 0.6, high: float = 10.0, noise: np.ndarray | None = None
) -> np.ndarray:
    """Gaussian of drawn shape (two eigenvalues, one angle, each from a uniform number), off centre by the scale factor."""
    e1, e2 = low + u[0] * (high - low), low + u[1] * (high - low)
    angle = u[2] * np.pi
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    inverse = np.linalg.inv(turn @ np.diag([e1, e2]) @ turn.T)
    axis = np.arange(size) - (size // 2 - 0.5 * (scale - 1))
    grid = np.stack(np.meshgrid(axis, axis), -1)
    k = np.exp(-0.5 * np.einsum("...i,ij,...j->...", grid, inverse, grid))
    if noise is not None:
        k = k * (1 + noise)
    return k / k.sum()


def laplacian(alpha: float) -> np.ndarray:
    alpha = min(max(alpha, 0.0), 1.0)
    corner, edge = alpha / (alpha + 1), (1 - alpha) / (alpha + 1)
    return np.array([[corner, edge, corner], [edge, -4 / (alpha + 1), edge], [corner, edge, corner]])


def double_scale_kernel(k: np.ndarray) -> np.ndarray:
    """Kernel of a x4 step from the kernel of a x2 step: k convolved with itself on a doubled grid, edges cut."""
    n = len(k)
    spread = np.zeros((2 * n - 1, 2 * n - 1))
    spread[::2, ::2] = k
    full = np.zeros((3 * n - 2, 3 * n - 2))
    for (y, x), w in np.ndenumerate(k):
        full[y : y + 2 * n - 1, x : x + 2 * n - 1] += w * spread
    cut = n // 2
    inner = full[cut:-cut, cut:-cut]
    return inner / inner.sum()


def shifted_kernel(k: np.ndarray, scale: int, upper_left: bool = True) -> np.ndarray:
    """Move by half a pixel per scale step, linear interpolation, edges held, sum 1."""
    offset = (scale - 1) * 0.5 * (1 if upper_left else -1)
    rows, cols = shift_weights(k.shape[0], offset), shift_weights(k.shape[1], offset)
    moved = cols.along(rows.along(k, 0), 1)
    return moved / moved.sum()


def binomial(size: int) -> np.ndarray:
    row = np.array([1.0])
    for _ in range(size - 1):
        row = np.convolve(row, [1.0, 1.0])
    k = np.outer(row, row)
    return k / k.sum()


def kernel_table(kind: str, **p) -> np.ndarray:
    """A named kernel: isotropic, anisotropic, random, laplacian, double, shifted, binomial."""
    makers = {
        "isotropic": isotropic_gaussian,
        "anisotropic": anisotropic_gaussian,
        "random": random_gaussian,
        "laplacian": laplacian,
        "double": double_scale_kernel,
        "shifted": shifted_kernel,
        "binomial": binomial,
    }
    return makers[kind](**p)
