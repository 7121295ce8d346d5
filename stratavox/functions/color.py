"""Colour space expressions on red, green and blue columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the MATLAB colour transform, and luma weights.
RGB_TO_YCBCR = {
    "Y": (65.481, 128.553, 24.966, 16.0),
    "Cb": (-37.797, -74.203, 112.0, 128.0),
    "Cr": (112.0, -93.786, -18.214, 128.0),
}
YCBCR_TO_RGB = {
    "r": (0.00456621, 0.0, 0.00625893, -222.921),
    "g": (0.00456621, -0.00153632, -0.00318811, 135.576),
    "b": (0.00456621, 0.00791071, 0.0, -276.836),
}
GRAY = (0.299, 0.587, 0.114)


def _linear(parts, weights) -> Column:
    a, b, c = parts
    return a * weights[0] + b * weights[1] + c * weights[2]


def rgb_to_ycbcr(r: Column, g: Column, b: Column, levels: bool = False) -> dict[str, Column]:
    """``levels`` True: bytes in, rounded bytes out; False: [0, 1] in and out."""
    parts = (r, g, b) if levels else (r * 255.0, g * 255.0, b * 255.0)
    out = {name: _linear(parts, w[:3]) / 255.0 + w[3] for name, w in RGB_TO_YCBCR.items()}
    return {n: F.rint(c).cast("int") if levels else c / 255.0 for n, c in out.items()}


def bgr_to_ycbcr(b: Column, g: Column, r: Column, levels: bool = False) -> dict[str, Column]:
    return rgb_to_ycbcr(r, g, b, levels)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, levels: bool = False) -> dict[str, Column]:
    parts = (y, cb, cr) if levels else (y * 255.0, cb * 255.0, cr * 255.0)
    out = {name: _linear(parts, w[:3]) * 255.0 + w[3] for name, w in YCBCR_TO_RGB.items()}
    return {n: F.rint(c).cast("int") if levels else c / 255.0 for n, c in out.items()}


def gray(r: Column, g: Column, b: Column) -> Column:
    return _linear((r, g, b), GRAY)


def channel_convert(channels: dict[str, Column], target: str) -> dict[str, Column]:
    """'gray', 'y' (from r, g, b), 'RGB' (replicate one channel), 'BGR' (swap); alpha is dropped."""
    kept = {k: v for k, v in channels.items() if k != "a"}
    if len(kept) == 3 and target == "gray":
        return {"gray": gray(kept["r"], kept["g"], kept["b"])}
    if len(kept) == 3 and target == "y":
        return {"y": rgb_to_ycbcr(kept["r"], kept["g"], kept["b"])["Y"]}
    if len(kept) == 1 and target == "RGB":
        (only,) = kept.values()
        return {"r": only, "g": only, "b": only}
    if len(kept) == 3 and target == "BGR":
        return {"r": kept["b"], "g": kept["g"], "b": kept["r"]}
    return kept
