"""Expressions on array columns. Used for vectors of tens to hundreds of entries, one array per row."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times (a plain reuse would be evaluated for every array entry)."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2_normalize(f: Column, eps: float = 1e-7) -> Column:
    return let(F.sqrt(dot(f, f)) + eps, lambda norm: F.transform(f, lambda v: v / norm))


def standardize_groups(f: Column, groups: int, length: int, eps: float = 1e-7) -> Column:
    """Split ``length`` channels in equal groups; (x - mean) / (sample deviation + eps) inside each."""
    size = length // groups

    def scaled(part: Column, mean: Column) -> Column:
        squares = total(F.transform(part, lambda v: (v - mean) * (v - mean)))
        return let(F.sqrt(squares / (size - 1)) + eps, lambda spread: F.transform(part, lambda v: (v - mean) / spread))

    def one(g: Column) -> Column:
        part = F.slice(f, g * size + 1, F.lit(size))
        return let(part, lambda p: let(total(p) / size, lambda mean: scaled(p, mean)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), one))


def sinusoidal_embedding(t: Column, dim: int, max_period: float = 10000.0, sine_first: bool = False) -> Column:
    """Cosines then sines of t at geometric frequencies; a zero closes an odd length.

    ``sine_first`` gives the variant with sines before cosines and a divisor of half - 1.
    """
    half = dim // 2
    divisor = half - 1 if sine_first else half
    angles = F.transform(
        F.sequence(F.lit(0), F.lit(half - 1)),
        lambda i: t * F.exp(F.lit(-math.log(max_period)) * i / F.lit(float(divisor))),
    )
    cosine, sine = F.transform(angles, F.cos), F.transform(angles, F.sin)
    both = F.concat(sine, cosine) if sine_first else F.concat(cosine, sine)
    return F.concat(both, F.array(F.lit(0.0))) if dim % 2 else both


def log_sum_exp(values: Column) -> Column:
    return let(F.array_max(values), lambda top: top + F.ln(total(F.transform(values, lambda v: F.exp(v - top)))))


def first_argmax(values: Column) -> Column:
    """0-based position of the first largest entry."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1
