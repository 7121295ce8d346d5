"""Streams over several triggers equal their batch twins."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratavox.operators import recurrence
from stratavox.streaming import averages, ordered, replay, sink


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of five keys, one of them with most rows, in four files by time."""
    root = tmp_path_factory.mktemp("events")
    rng = np.random.default_rng(0)
    rows = [
        (int(rng.choice([0, 0, 0, 0, 1, 2, 3, 4])), f"2024-01-0{1 + i // 100} {i % 24:02d}:00:00", i, float(rng.normal()))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "key bigint, at string, event_id bigint, v double")
    df = df.select("key", F.col("at").cast("timestamp_ntz").alias("ts"), "event_id", "v")
    for part in range(4):
        df.where(F.floor(F.col("event_id") / 100) == part).coalesce(1).write.mode("append").parquet(str(root))
    return str(root)


def stream(spark, folder):
    return sink.read_files(spark, folder, "*.parquet", files_per_batch=1)


@pytest.mark.parametrize("parts", [0, 3])
def test_a_table_is_a_file_or_a_folder(spark, tmp_path, parts):
    rows = spark.range(60).selectExpr("id % 4 AS key", "id AS event_id", "CAST(id AS double) AS v")
    rows.repartition(parts or 1).write.parquet(str(tmp_path / "made"))
    if parts:
        (tmp_path / "made").rename(tmp_path / "t.parquet")
    else:
        next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "t.parquet")
    rows.write.parquet(str(tmp_path / "other.parquet"))
    got = sink.run_available(sink.read_files(spark, str(tmp_path), "t.parquet", files_per_batch=1))
    assert sorted(r["event_id"] for r in got.collect()) == list(range(60))


def test_replay(spark, folder):
    got = sink.run_available(replay.replay_stream(stream(spark, folder), 8, seed=1, order=("event_id",))).toPandas()
    want = replay.replay_batch(spark.read.parquet(folder), 8, seed=1, order=("event_id",)).toPandas()
    got, want = (f.sort_values(["key", "n"]).reset_index(drop=True)[["key", "n", "v", "emitted"]] for f in (got, want))
    assert got.equals(want)
    late = want[want["n"] >= 8]
    assert 0.3 < (late["v"] != late["emitted"]).mean() < 0.7
    early = want[want["n"] < 8]
    assert (early["v"] == early["emitted"]).all()


def test_average(spark, folder):
    got = sink.run_available(averages.ema_stream(stream(spark, folder), order=("event_id",))).toPandas()
    want = recurrence.ema(spark.read.parquet(folder), ["event_id"], recurrence.warmup_decay).toPandas()
    got, want = (f.sort_values(["key", "n"]) for f in (got, want))
    assert np.allclose(got["ema"], want["ema"])


def test_epoch_means_close_epochs_only(spark, folder):
    named = lambda df: df.select("ts", F.lit("l1").alias("name"), F.col("v").alias("value"))
    got = sink.run_available(averages.epoch_metric_means(named(stream(spark, folder)))).toPandas()
    want = averages.epoch_metric_means(named(spark.read.parquet(folder))).toPandas().set_index("epoch_start")["mean"]
    assert len(got) == 3
    assert all(np.isclose(r.mean, want[r.epoch_start]) for r in got.itertuples(index=False))


@pytest.fixture(scope="module")
def late_folder(spark, tmp_path_factory):
    """Rows of three string keys in files by arrival: event times come up to 50 minutes late, a sentinel closes all slots."""
    root = tmp_path_factory.mktemp("late")
    rng = np.random.default_rng(3)
    at = np.sort(rng.integers(0, 12 * 3600, 900)) + rng.integers(-3000, 1, 900)
    rows = [(f"k{i % 3 if i % 5 else 0}", 1_700_000_000 + int(s), i, float(rng.normal())) for i, s in enumerate(at)]
    rows.append(("end", 1_700_000_000 + 20 * 3600, 900, 0.0))
    for part in range(5):
        mine = rows[part * 180 : (part + 1) * 180 if part < 4 else None]
        df = spark.createDataFrame(mine, "key string, s long, event_id long, v double")
        df.select("key", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "event_id", "v").coalesce(1).write.mode("append").parquet(str(root))
    return str(root)


def same_rows(got, want, columns):
    got, want = (f.sort_values(["key", "n"]).reset_index(drop=True)[["key", "n", *columns]] for f in (got, want))
    assert got["key"].tolist() == want["key"].tolist() and got["n"].tolist() == want["n"].tolist()
    for c in columns:
        assert np.allclose(got[c], want[c])


@pytest.mark.parametrize("slot", [60, 7200])
def test_late_rows_are_taken_where_they_belong(spark, late_folder, slot):
    order = ("ts", "event_id")
    closed = spark.read.parquet(late_folder).where("key <> 'end'")
    timing = {"late": "1 hour", "slot_seconds": slot}
    got = sink.run_available(averages.ema_stream_in_time(stream(spark, late_folder), **timing)).toPandas()
    same_rows(got, recurrence.ema(closed, order, recurrence.warmup_decay).toPandas(), ["ema"])
    got = sink.run_available(replay.replay_stream_in_time(stream(spark, late_folder), 8, seed=1, **timing)).toPandas()
    same_rows(got, replay.replay_batch(closed, 8, seed=1, order=order).toPandas(), ["v", "emitted"])


@pytest.mark.parametrize("in_time", [False, True])
def test_a_million_rows_of_one_key_in_one_trigger(spark, tmp_path, in_time):
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit("hot").alias("key"),
        F.timestamp_micros(F.col("id") * 7919 % n * 10_000 + 1_700_000_000_000_000).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("event_id"),
        F.rand(4).alias("v"),
    )
    rows.union(spark.sql("SELECT 'end', timestamp_ntz '2024-01-01', -1L, 0D")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = sink.read_files(spark, str(tmp_path / "in"), "*.parquet")
    made = averages.ema_stream_in_time(source, slot_seconds=600) if in_time else averages.ema_stream(source)
    got = sink.run_available(made).where("key = 'hot'").orderBy("n").toPandas()
    want = spark.read.parquet(str(tmp_path / "in")).where("key = 'hot'").orderBy("ts").toPandas()["v"].to_numpy()
    assert len(got) == n
    s, at = None, {0, 5, 8191, 50_000, 123_456, n - 1}
    for i, v in enumerate(want.tolist()):
        keep = min(0.9999, (1 + i) / (10 + i))
        s = v if s is None else s - (1 - keep) * (s - v)
        if i in at:
            assert np.isclose(got["ema"][i], s)


class CountedState:
    """Value and map state and timers of one key, in memory, with the number of calls."""

    def __init__(self):
        self.calls, self.timers, self.held = 0, set(), {}

    def state(self, name, *schema):
        return CountedVariable(self, name)

    getMapState = getValueState = state

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class CountedVariable:
    def __init__(self, owner, name):
        self.owner, self.name = owner, name

    def put(self, key, value):
        self.owner.calls += 1
        self.owner.held[self.name, key] = value

    def look(self, key=None):
        self.owner.calls += 1
        return self.owner.held.get((self.name, key))

    def drop(self, key=None):
        self.owner.calls += 1
        self.owner.held.pop((self.name, key))

    get, getValue, clear, removeKey, updateValue = look, look, drop, drop, put

    def update(self, value):
        self.put(None, value)

    def exists(self):
        return self.look() is not None

    def containsKey(self, key):
        return self.look(key) is not None


def test_calls_to_the_state_do_not_grow_with_slots(monkeypatch):
    monkeypatch.setattr(ordered, "OUT_ROWS", 700)
    rng = np.random.default_rng(1)
    at = np.concatenate([rng.permutation(2000) * 1_000_000, rng.integers(5_000_000, 6_000_000, 9000)])
    rows = pd.DataFrame({"at": at, "tie": rng.permutation(11_000), "v": rng.random(11_000)})
    key, state, chain = ("k",), CountedState(), ordered.TimedChain(averages.EmaChain(0.9), 1000)
    chain.init(state)
    got = []
    for half in range(2):
        assert not list(chain.handleInputRows(key, iter([rows[half::2]]), None))
    for passed, done in ((1500, 10_500), (3000, 11_000)):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: passed * 1000)
        while state.timers and min(state.timers) <= passed * 1000:
            first = min(state.timers)
            got += chain.handleExpiredTimer(key, now, SimpleNamespace(getExpiryTimeInMs=lambda: first))
            state.timers.remove(first)
        assert sum(len(f) for f in got) == done
    assert state.calls < 150
    assert set(state.held) == {("progress", None)} and not state.timers
    want = averages.EmaChain(0.9).take("k", (0.0, 0), rows.sort_values(["at", "tie"])["v"].to_numpy())[1]["ema"]
    made = pd.concat(got)
    assert made["n"].tolist() == list(range(11_000)) and np.allclose(made["ema"], want)
