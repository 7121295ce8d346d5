"""Exponential averages and epoch means on streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.operators.recurrence import compose_runs
from stratavox.streaming.ordered import Chain, by_arrival, by_time, utc_instant

MADE = "n bigint, ema double"


class EmaChain(Chain):
    """State per key: the average and the number of updates."""

    fields = "s double, n bigint"
    made = ("n", "ema")

    def __init__(self, decay: float):
        self.decay = decay

    def first(self) -> tuple:
        return (0.0, 0)

    def take(self, key, state: tuple, values: np.ndarray) -> tuple[tuple, dict[str, np.ndarray]]:
        s, count = state
        n = count + np.arange(len(values))
        keep = np.where(n == 0, 0.0, np.minimum(self.decay, (1 + n) / (10 + n)))
        p, q = compose_runs(keep, (1 - keep) * values, np.arange(len(values)) == 0)
        made = p * s + q
        return (float(made[-1]), count + len(values)), {"n": n, "ema": made}


def ema_stream(stream: DataFrame, decay: float = 0.9999, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """key, n, ema: arrivals of one trigger are taken in ``order``."""
    return by_arrival(stream, EmaChain(decay), MADE, order)


def ema_stream_in_time(stream: DataFrame, decay: float = 0.9999, **timing) -> DataFrame:
    """key, n, ema: rows are taken in the order of event time, once the watermark has passed them (``by_time``)."""
    return by_time(stream, EmaChain(decay), MADE, **timing)


def epoch_metric_means(df: DataFrame, ts: str = "ts", epoch: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean of each named metric per epoch (a tumbling window). On a stream, an epoch is emitted when it can no longer change."""
    timed = df.withColumn("_at", utc_instant(ts)).withWatermark("_at", late)
    means = timed.groupBy(F.window("_at", epoch).alias("w"), "name").agg(F.avg("value").alias("mean"))
    return means.select(F.unix_seconds("w.start").alias("epoch_start"), "name", "mean")
