"""Exponential averages over ordered rows, for keys of any length.

s(n) = d(n) s(n-1) + (1 - d(n)) p(n) is a chain of affine maps x -> a x + b. A key is cut in chunks of ``CHUNK`` rows; a task composes
the maps of its chunks by a strided scan of whole Arrow batches, many short keys or one long chunk at a time, and carries a chunk
over the end of a batch. The totals of chunks are scanned in the same way, and every chunk goes on from the total before it.
No product is ever divided by, so decays of 0 and values of any size are exact to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.scale import attach_small, prefix_sum
from stratavox.session import settle

CHUNK = 1 << 16
STRIP = 256


def warmup_decay(n: Column, decay: float = 0.9999) -> Column:
    """min(decay, (1 + n) / (10 + n)) for update n."""
    return F.least(F.lit(decay), (n + 1) / (n + 10))


def compose_runs(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composition of the maps of each run up to every place; ``first`` is true where a run begins.

    Runs are cut in strips of ``STRIP`` places. Step k takes place k of all strips at once, in the order of a plain loop; the
    totals of strips are composed in the same way and carried on.
    """
    p, q = a.astype(float), b.astype(float)
    if not len(p):
        return p, q
    place = np.arange(len(p))
    since = place - np.maximum.accumulate(np.where(first, place, 0))
    begin = np.flatnonzero(since % STRIP == 0)
    size = np.diff(np.append(begin, len(p)))
    by_size = np.argsort(-size, kind="stable")
    starts, longest = begin[by_size], -size[by_size]
    for k in range(1, int(-longest[0])):
        at = starts[: np.searchsorted(longest, -k)] + k
        q[at] += p[at] * q[at - 1]
        p[at] *= p[at - 1]
    heads = since[begin] == 0
    if heads.all():
        return p, q
    ends = begin + size - 1
    whole_p, whole_q = compose_runs(p[ends], q[ends], heads)
    later = np.flatnonzero(~heads)
    strip = np.repeat(later, size[later])
    at = np.repeat(begin[later] - np.cumsum(size[later]) + size[later], size[later]) + np.arange(len(strip))
    q[at] += p[at] * whole_q[strip - 1]
    p[at] *= whole_p[strip - 1]
    return p, q


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``_p``, ``_q``: rows come sorted by key, chunk and place."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch["key"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        chunk = batch["_chunk"].to_numpy()
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])
        a, b = batch["_a"].to_numpy(zero_copy_only=False).copy(), batch["_b"].to_numpy(zero_copy_only=False).copy()
        if held is not None and held[:2] == (batch["key"][0].as_py(), chunk[0]):
            a[0], b[0] = a[0] * held[2], a[0] * held[3] + b[0]
        p, q = compose_runs(a, b, first)
        held = (batch["key"][-1].as_py(), chunk[-1], p[-1], q[-1])
        yield batch.append_column("_p", pa.array(p)).append_column("_q", pa.array(q))


def scan_maps(maps: DataFrame) -> DataFrame:
    """Adds ``_q``: what each map and all earlier ones of its key make of a start value of 0. Other columns stay.

    ``maps``: key, _at (0, 1, ... inside a key), _a, _b. A chunk is sorted and composed in one task; a long key is many chunks.
    """
    chunked = maps.withColumn("_chunk", F.floor(F.col("_at") / CHUNK).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunked.schema.fields)
    sorted_rows = chunked.repartition("key", "_chunk").sortWithinPartitions("key", "_chunk", "_at")
    inside = settle(sorted_rows.mapInArrow(_composed, f"{schema}, _p double, _q double"))
    # One row per key and chunk, and only for keys of more than one chunk.
    totals = (
        inside.groupBy("key", "_chunk").agg(F.max_by("_p", "_at").alias("_a"), F.max_by("_q", "_at").alias("_b")).withColumnRenamed("_chunk", "_at")
    )
    most = inside.agg(F.max("_chunk")).head()[0]
    done = inside.drop("_a", "_b")
    if not most:
        return done.drop("_chunk", "_p")
    long_keys = inside.where("_chunk > 0").select("key").distinct()
    before = scan_maps(totals.join(long_keys, "key"))
    starts = before.select("key", (F.col("_at") + 1).alias("_chunk"), F.col("_q").alias("_start"))
    met = attach_small(done, starts, ["key", "_chunk"], "left")
    return met.withColumn("_q", F.col("_p") * F.coalesce("_start", F.lit(0.0)) + F.col("_q")).drop("_chunk", "_p", "_start")


def ema(
    df: DataFrame,
    order: Sequence[str],
    decay: Callable[[Column], Column],
    value: str = "v",
    out: str = "ema",
) -> DataFrame:
    """Running average per ``key``; the first value starts it and update n has weight 1 - decay(n). Adds ``n`` and ``out``."""
    ranked = prefix_sum(df, ["key"], list(order), {}, rank="_at").withColumn("_at", (F.col("_at") - 1).cast("long"))
    n = F.col("_at")
    maps = ranked.withColumns(
        {
            # The first value replaces the state; later ones decay it.
            "_a": F.when(n == 0, F.lit(0.0)).otherwise(decay(n)).cast("double"),
            "_b": F.when(n == 0, F.col(value)).otherwise((1 - decay(n)) * F.col(value)).cast("double"),
        }
    )
    return scan_maps(maps).withColumnsRenamed({"_q": out, "_at": "n"})


def ema_center(df: DataFrame, order: Sequence[str], decay: float = 0.999, value: str = "v") -> DataFrame:
    """Value minus its slow average (the first value starts the average)."""
    return ema(df, order, lambda n: F.lit(decay), value).withColumn("centered", F.col(value) - F.col("ema"))
