"""Reproducible draws: a value depends on (seed, stream, key) only, never on partitioning or retries."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def uniform(seed: int, stream: str, *key: Column) -> Column:
    """Uniform draw in [0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(TWO_32)


def gaussian(seed: int, stream: str, *key: Column) -> Column:
    """Standard normal draw (Box-Muller on two uniform streams)."""
    u = F.lit(1.0) - uniform(seed, stream + "/r", *key)
    angle = uniform(seed, stream + "/a", *key)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(6.283185307179586) * angle)


def integer(seed: int, stream: str, low, high, *key: Column) -> Column:
    """Uniform integer in [low, high)."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (low + F.floor(uniform(seed, stream, *key) * (high - low))).cast("int")


def numpy_seed(seed: int, stream: str, key) -> list[int]:
    """Seed words for a numpy generator inside a task, keyed in the same way."""
    digest = hashlib.md5(f"{seed}:{stream}:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]
