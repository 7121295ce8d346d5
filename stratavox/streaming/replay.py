"""Replay buffer per key: fill ``size`` places, then swap with a random held element half of the time.

Whether element n swaps, and with which place, are draws keyed on (key, n), so the stream and the batch form agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions import draws
from stratavox.scale import prefix_sum
from stratavox.streaming.ordered import Chain, by_arrival, by_time

MADE = "n bigint, v double, emitted double"


def _uniform(seed: int, stream: str, key, n: int) -> float:
    return draws.numpy_seed(seed, stream, f"{key}:{n}")[0] / draws.TWO_32


class ReplayChain(Chain):
    """State per key: how many elements came, and the at most ``size`` that are held."""

    fields = "n bigint, held array<double>"
    made = ("n", "v", "emitted")

    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed

    def first(self) -> tuple:
        return (0, [])

    def take(self, key, state: tuple, values: np.ndarray) -> tuple[tuple, dict[str, np.ndarray]]:
        count, held = state[0], list(state[1])
        emitted = values.astype(float)
        for i, v in enumerate(emitted.tolist()):
            n = count + i
            if n < self.size:
                held.append(v)
            elif _uniform(self.seed, "swap", key, n) > 0.5:
                place = int(_uniform(self.seed, "place", key, n) * self.size)
                emitted[i], held[place] = held[place], v
        return (count + len(values), held), {"n": count + np.arange(len(values)), "v": values, "emitted": emitted}


def replay_stream(stream: DataFrame, size: int = 50, seed: int = 0, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """``stream`` has key, v and the order columns; arrivals of one trigger are taken in that order."""
    return by_arrival(stream, ReplayChain(size, seed), MADE, order)


def replay_stream_in_time(stream: DataFrame, size: int = 50, seed: int = 0, **timing) -> DataFrame:
    """Elements are taken in the order of event time, once the watermark has passed them (``by_time``)."""
    return by_time(stream, ReplayChain(size, seed), MADE, **timing)


def replay_batch(rows: DataFrame, size: int = 50, seed: int = 0, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The same result from a table, without replaying: a swap emits what was last put in its place.

    Elements are numbered by a distributed rank; the last writer of a (key, place) is a running maximum.
    """
    ranked = prefix_sum(rows, ["key"], list(order), {}, rank="n").withColumn("n", F.col("n") - 1)
    key, n = F.col("key"), F.col("n")
    swaps = (n >= size) & (draws.uniform(seed, "swap", key, n) > 0.5)
    place = F.when(n < size, n.cast("int")).when(swaps, draws.integer(seed, "place", 0, size, key, n))
    placed = ranked.select("key", "n", "v", place.alias("place"))
    writers = prefix_sum(placed.where("place IS NOT NULL"), ["key", "place"], ["n"], {}, previous={"source": "n"})
    taken = writers.where(n >= size).select("key", "n", "source")
    found = taken.join(
        placed.select("key", F.col("n").alias("source"), F.col("v").alias("old")), ["key", "source"]
    ).select("key", "n", "old")
    return placed.join(found, ["key", "n"], "left").select("key", "n", "v", F.coalesce("old", "v").alias("emitted"))
