"""Stateful and streaming queries. A stream and its batch twin answer to the same SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox import fixtures as fx
from stratavox.catalogue.geometry import draw_sql
from stratavox.catalogue.metrics import EMA
from stratavox.catalogue.registry import query
from stratavox.scale import exact_quantiles
from stratavox.operators.layout import slices_to_voxels
from stratavox.streaming import averages, ingest, replay, sink


def event_stream(spark, sf):
    events = sink.read_files(spark, sf, "events.parquet")
    return events.select(F.col("user_id").alias("key"), "ts", "event_id", F.col("value").alias("v"))


REPLAY = f"""WITH s AS (SELECT user_id AS key, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS n FROM events),
p AS (SELECT *, CASE WHEN n < 20 THEN n WHEN {draw_sql(23, "swap", "key", "n")} > 0.5 THEN CAST(floor({draw_sql(23, "place", "key", "n")}*20) AS INT) END AS place FROM s),
w AS (SELECT key, n, lag(v) OVER (PARTITION BY key, place ORDER BY n) AS old FROM p WHERE place IS NOT NULL)
SELECT p.key, p.n, p.v, CASE WHEN p.n < 20 THEN p.v ELSE coalesce(w.old, p.v) END AS emitted FROM p LEFT JOIN w ON p.key=w.key AND p.n=w.n"""


@query("st1_replay_batch", REPLAY)
def st1_replay_batch(spark, sf):
    return replay.replay_batch(fx.series(spark, sf).select("key", "ts", "event_id", "v"), 20, seed=23)


@query("st1_replay_stream", REPLAY)
def st1_replay_stream(spark, sf):
    return sink.run_available(replay.replay_stream(event_stream(spark, sf), 20, seed=23))


@query(
    "st2_ema_stream",
    f"{EMA} SELECT key, n, round(list_reduce(h, lambda a, b: {{'n': b.n, 'v': a.v-(1-least(0.9999,(1+b.n)/(10.0+b.n)))*(a.v-b.v)}}).v,6) AS ema FROM l",
)
def st2_ema_stream(spark, sf):
    out = sink.run_available(averages.ema_stream(event_stream(spark, sf)))
    return out.withColumn("ema", F.round("ema", 6))


#: Slots of an hour whose end the watermark, an hour behind the last event, has passed.
CLOSED = "WHERE epoch_ms(date_trunc('hour', ts)) + 3600000 <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events)"


@query("st1_replay_stream_in_time", REPLAY.replace("FROM events)", f"FROM events {CLOSED})", 1))
def st1_replay_stream_in_time(spark, sf):
    """Elements in the order of event time; the last hours stay open."""
    return sink.run_available(replay.replay_stream_in_time(event_stream(spark, sf), 20, seed=23, slot_seconds=3600))


@query(
    "st2_ema_stream_in_time",
    f"{EMA.replace('FROM events)', f'FROM events {CLOSED})', 1)} SELECT key, n, round(list_reduce(h, lambda a, b: {{'n': b.n, 'v': a.v-(1-least(0.9999,(1+b.n)/(10.0+b.n)))*(a.v-b.v)}}).v,6) AS ema FROM l",
)
def st2_ema_stream_in_time(spark, sf):
    out = sink.run_available(averages.ema_stream_in_time(event_stream(spark, sf), slot_seconds=3600))
    return out.withColumn("ema", F.round("ema", 6))


MEANS = "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS epoch_start, event_type AS name, round(avg(value),6) AS mean FROM events {w} GROUP BY ALL"


@query("st3_epoch_metric_means", MEANS.format(w=""))
def st3_epoch_metric_means(spark, sf):
    rows = fx.table(spark, sf, "events").select("ts", F.col("event_type").alias("name"), "value")
    return averages.epoch_metric_means(rows).withColumn("mean", F.round("mean", 6))


@query(
    "st3_epoch_metric_stream",
    MEANS.format(w="WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"),
)
def st3_epoch_metric_stream(spark, sf):
    """Closed epochs only: the last day stays open."""
    events = sink.read_files(spark, sf, "events.parquet").select("ts", F.col("event_type").alias("name"), "value")
    return sink.run_available(averages.epoch_metric_means(events)).withColumn("mean", F.round("mean", 6))


@query(
    "st4_incremental_ingest",
    f"""WITH {fx.VOXELS_SQL}, q AS (SELECT volume_id, quantile_cont(v, 0.001) AS p0, quantile_cont(v, 0.999) AS p1 FROM voxels GROUP BY volume_id)
SELECT volume_id, vec_id AS z, CAST(x//4 AS INT) AS gx, CAST(y//4 AS INT) AS gy, CAST(x%4*4+y%4 AS INT) AS pos, round((greatest(least(v,p1),p0)-p0)/(p1-p0)*2-1,6) + 0.0 AS v FROM voxels JOIN stack USING (volume_id, z) JOIN q USING (volume_id)""",
)
def st4_incremental_ingest(spark, sf):
    """A file stream of slices, rescaled by the percentiles a batch job keeps."""
    probs = {"p_lo": 0.001, "p_hi": 0.999}
    stats = exact_quantiles(slices_to_voxels(fx.slices(spark, sf)), ["volume_id"], "v", probs)
    stream = sink.read_files(spark, sf, "embeddings.parquet").select(
        F.col("label").alias("volume_id"),
        F.col("vec_id").alias("z"),
        F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        F.col("embedding").cast("array<double>").alias("data"),
    )
    tiles = sink.run_available(ingest.ingest_tiles(stream, stats.select("volume_id", "p_lo", "p_hi"), 4))
    cells = tiles.select("volume_id", "z", "gx", "gy", F.posexplode("f").alias("pos", "v"))
    return cells.withColumn("v", F.round("v", 6) + 0.0)
