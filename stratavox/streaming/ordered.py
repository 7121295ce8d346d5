"""Keyed state for values that must be taken in order.

Two ways to get them in order, for keys of any type:

* ``by_arrival``: the rows of one trigger are taken in the given order, triggers one after the other. Frames of a key are turned into
  plain arrays as they come in, and results leave in pieces.
* ``by_time``: rows wait in map state, in pieces of at most ``PIECE`` rows, and an event-time timer releases the slots of event time
  whose end the watermark has passed. Slots are released in order, so rows that come late, but not later than the watermark
  allows, are taken where they belong, and the stream equals the batch over all released slots.

Neither holds frames of a key together: a value takes 24 bytes while its slot (or its trigger) is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PIECE = 8192
OUT_ROWS = 50_000
#: Rows of several slots that may wait in one piece.
FEW = 256
#: at: microseconds, tie: what orders rows of one instant, v: the value.
COLUMNS = ("at", "tie", "v")


def utc_instant(ts: str) -> Column:
    """A zone-free timestamp read as UTC, whatever the session zone is."""
    parts = f"year({ts}), month({ts}), day({ts}), hour({ts}), minute({ts}), extract(SECOND FROM {ts})"
    return F.expr(f"make_timestamp({parts}, 'UTC')")


class Chain(StatefulProcessor):
    """A processor whose state is a value (``fields``) and that takes arrays of values in order."""

    fields = ""
    made: tuple[str, ...] = ()

    def first(self) -> tuple:
        raise NotImplementedError

    def take(self, key, state: tuple, values: np.ndarray) -> tuple[tuple, dict[str, np.ndarray]]:
        """The new state, and the columns ``made`` for ``values``."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", self.fields)

    def frames(self, key, at: np.ndarray, tie: np.ndarray, v: np.ndarray) -> Iterator[pd.DataFrame]:
        """Rows of one trigger or slot, sorted and taken piece by piece."""
        order = np.lexsort((tie, at))
        state = self.progress.get() or self.first()
        for begin in range(0, len(order), OUT_ROWS):
            values = v[order[begin : begin + OUT_ROWS]]
            state, made = self.take(key[0], state, values)
            yield pd.DataFrame({"key": [key[0]] * len(values), **{c: made[c] for c in self.made}})
        self.progress.update(state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [[frame[c].to_numpy() for c in COLUMNS] for frame in rows]
        yield from self.frames(key, *(np.concatenate(x) for x in zip(*parts)))

    def close(self) -> None:
        pass


class TimedChain(StatefulProcessor):
    """A ``Chain`` whose rows wait for the watermark.

    A piece holds at most ``PIECE`` rows of one slot, or at most ``FEW`` rows of several. The index lists the pieces with their first
    slots; a key has one timer, at the end of its first slot, and when it fires, all slots the watermark has passed are taken. So
    calls to the state grow with the triggers in which a key gets or gives rows, not with its slots.
    """

    def __init__(self, chain: Chain, slot_ms: int):
        self.chain, self.slot_ms = chain, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chain.init(handle)
        self.pieces = handle.getMapState("pieces", "id bigint", "at array<bigint>, tie array<bigint>, v array<double>")
        self.index = handle.getValueState("index", "made bigint, timer bigint, id array<bigint>, first array<bigint>")

    def slots(self, at: np.ndarray) -> np.ndarray:
        return at // (1000 * self.slot_ms)

    def wait(self, rows: list[np.ndarray], made: int, listed: list[tuple]) -> int:
        """Puts rows into new pieces, adds these to ``listed`` and returns how many were ever made."""
        order = np.argsort(rows[0], kind="stable")
        rows = [x[order] for x in rows]
        slots = self.slots(rows[0])
        begins = np.flatnonzero(np.diff(slots, prepend=slots[0] - 1)).tolist()
        cuts = [0]
        for begin, end in zip(begins, [*begins[1:], len(slots)]):
            if begin > cuts[-1] and end - cuts[-1] > FEW:
                cuts.append(begin)
            while end - cuts[-1] > PIECE:
                cuts.append(cuts[-1] + PIECE)
        for begin, end in zip(cuts, [*cuts[1:], len(slots)]):
            self.pieces.updateValue((made,), tuple(x[begin:end].tolist() for x in rows))
            listed.append((made, int(slots[begin])))
            made += 1
        return made

    def keep(self, made: int, timer: int, listed: list[tuple]) -> None:
        """Writes the index and sees to the timer; ``timer`` is the one set so far, -1 if there is none."""
        ids, first = (list(x) for x in zip(*listed))
        due = (min(first) + 1) * self.slot_ms
        if due != timer:
            if timer != -1:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.index.update((made, due, ids, first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made, timer, *lists = self.index.get() or (0, -1, [], [])
        listed, parts, n = list(zip(*lists)), [], 0
        for frame in rows:
            parts.append([frame[c].to_numpy() for c in COLUMNS])
            n += len(frame)
            if n >= OUT_ROWS:
                made, parts, n = self.wait(_joined(parts), made, listed), [], 0
        if n:
            made = self.wait(_joined(parts), made, listed)
        self.keep(made, timer, listed)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // self.slot_ms
        made, _, *lists = self.index.get()
        entries = sorted(zip(*lists), key=lambda entry: entry[1])
        listed, parts, n, last = [entry for entry in entries if entry[1] >= passed], [], 0, None
        for piece, first in entries[: len(entries) - len(listed)]:
            if n >= OUT_ROWS and first > last:  # no later piece has rows before its first slot
                rows = _joined(parts)
                early = self.slots(rows[0]) < first
                yield from self.chain.frames(key, *(x[early] for x in rows))
                parts = [[x[~early] for x in rows]]
                n = len(parts[0][0])
            at, tie, v = self.pieces.getValue((piece,))
            self.pieces.removeKey((piece,))
            parts.append([np.array(at, np.int64), np.array(tie, np.int64), np.array(v, float)])
            n, last = n + len(at), first
        rows = _joined(parts)
        early = self.slots(rows[0]) < passed
        yield from self.chain.frames(key, *(x[early] for x in rows))
        if not early.all():
            made = self.wait([x[~early] for x in rows], made, listed)
        if listed:
            self.keep(made, -1, listed)
        else:
            self.index.clear()

    def close(self) -> None:
        self.chain.close()


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


def _schema(stream: DataFrame, made: str) -> str:
    return f"key {stream.schema['key'].dataType.simpleString()}, {made}"


def by_arrival(stream: DataFrame, chain: Chain, made: str, order: tuple[str, ...]) -> DataFrame:
    """``order``: one or two columns; times count in microseconds."""
    columns = [F.unix_micros(utc_instant(c)) if "timestamp" in dict(stream.dtypes)[c] else F.col(c).cast("long") for c in order]
    at, tie = (columns[0], columns[1]) if len(columns) > 1 else (columns[0], F.lit(0).cast("long"))
    rows = stream.select("key", at.alias("at"), tie.alias("tie"), F.col("v").cast("double").alias("v"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=chain, outputStructType=_schema(stream, made), outputMode="Append", timeMode="None"
    )


def by_time(stream: DataFrame, chain: Chain, made: str, ts: str = "ts", tie: str = "event_id", late: str = "1 hour", slot_seconds: int = 60) -> DataFrame:
    """``ts``: event time, ``tie``: a whole number that orders rows of one instant, ``late``: how late a row may come."""
    rows = stream.select(
        "key", utc_instant(ts).alias("_time"), F.unix_micros(utc_instant(ts)).alias("at"), F.col(tie).cast("long").alias("tie"), F.col("v").cast("double").alias("v")
    ).withWatermark("_time", late)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=TimedChain(chain, slot_seconds * 1000), outputStructType=_schema(stream, made), outputMode="Append", timeMode="EventTime"
    )
