"""Image-shaped tables derived from the given Parquet tables, with the same derivation in SQL.

Each ``*_SQL`` constant is a list of common table expressions for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions.vectors import let
from stratavox.operators.layout import slices_to_voxels
from stratavox.scale import attach_small, rank_ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per embedding with its place ``z`` in the stack of its label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("volume_id"), "vec_id", "embedding")
    return rank_ids(rows, ["volume_id"], "vec_id", "z")


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block rows: one 8x8 slice per row."""
    return stacked(spark, sf_dir).select(
        "volume_id",
        "z",
        F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        F.col("embedding").cast("array<double>").alias("data"),
    )


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices_to_voxels(slices(spark, sf_dir))


STACK_SQL = """stack AS (SELECT label AS volume_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS INT) AS z, vec_id, embedding FROM embeddings)"""

VOXELS_SQL = (
    STACK_SQL
    + """,
voxels AS (SELECT volume_id, z, CAST((i-1)//8 AS INT) AS x, CAST((i-1)%8 AS INT) AS y, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT volume_id, z, embedding, unnest(range(1,65)) AS i FROM stack))"""
)


def event_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse non-negative volumes: one per block of 24 users, 30 days deep, 24 hours x 24 users wide; empty cells are 0.

    A slice is filled from a list of at most 576 sums.
    """
    events = table(spark, sf_dir, "events")
    user = F.col("user_id")
    sums = events.groupBy(
        F.floor(user / 24).cast("int").alias("volume_id"),
        (F.dayofmonth("ts") - 1).alias("z"),
        (F.hour("ts") * 24 + user % 24).cast("int").alias("pos"),
    ).agg(F.round(F.sum("value"), 6).alias("v"))
    filled = sums.groupBy("volume_id", "z").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("cells"))
    blocks = events.select(F.floor(user / 24).cast("int").alias("volume_id")).distinct()
    dense = blocks.select("volume_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("z"))
    return dense.join(filled, ["volume_id", "z"], "left").select(
        "volume_id", "z", F.lit(24).alias("h"), F.lit(24).alias("w"), _dense("cells", 576).alias("data")
    )


def _dense(cells: str, n: int):
    """Sorted (pos, v) entries to a full array: runs of zeros between the entries, one pass."""
    filled = let(
        F.col(cells),
        lambda c: F.concat(
            F.flatten(
                F.zip_with(
                    c,
                    F.concat(F.array(F.lit(-1)), F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda e: e["pos"])),
                    lambda e, before: F.concat(F.array_repeat(F.lit(0.0), e["pos"] - before - 1), F.array(e["v"])),
                )
            ),
            F.array_repeat(F.lit(0.0), n - 1 - F.element_at(c, -1)["pos"]),
        ),
    )
    return F.when(F.col(cells).isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(filled)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of the label stacks: a count that reads one column."""
    labels = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("volume_id"))
    return labels.agg(F.count(F.lit(1)).cast("int").alias("nz")).withColumns({"nx": F.lit(8), "ny": F.lit(8)})


def event_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 24).cast("int").alias("volume_id"))
    return blocks.distinct().withColumns({"nz": F.lit(30), "nx": F.lit(24), "ny": F.lit(24)})


def event_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices_to_voxels(event_slices(spark, sf_dir))


EVENTS_SQL = """event_sums AS (SELECT CAST(user_id//24 AS INT) AS volume_id, CAST(day(ts)-1 AS INT) AS z, CAST(hour(ts) AS INT) AS x, CAST(user_id%24 AS INT) AS y, round(sum(value),6) AS v FROM events GROUP BY ALL),
grid AS (SELECT volume_id, CAST(a.range AS INT) AS z, CAST(b.range AS INT) AS x, CAST(c.range AS INT) AS y FROM (SELECT DISTINCT volume_id FROM event_sums), range(0,30) a, range(0,24) b, range(0,24) c),
event_voxels AS (SELECT g.volume_id, g.z, g.x, g.y, coalesce(s.v,0.0) AS v FROM grid g LEFT JOIN event_sums s ON g.volume_id=s.volume_id AND g.z=s.z AND g.x=s.x AND g.y=s.y)"""


def event_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24x24 colour images in [0, 1): pages and signups, clicks and errors, purchases of one user block and day."""
    events = table(spark, sf_dir, "events")
    user, kind = F.col("user_id"), F.col("event_type")
    channel = F.when(kind.isin("view", "signup"), 0).when(kind.isin("click", "error"), 1).otherwise(2)
    sums = events.groupBy(
        F.floor(user / 24).cast("int").alias("volume_id"),
        (F.dayofmonth("ts") - 1).alias("z"),
        ((F.hour("ts") * 24 + user % 24) * 3 + channel).cast("int").alias("pos"),
    ).agg(F.round(F.sum("value"), 6).alias("v"))
    level = F.col("v") / (F.col("v") + 50.0)
    filled = sums.groupBy("volume_id", "z").agg(
        F.sort_array(F.collect_list(F.struct("pos", level.alias("v")))).alias("cells")
    )
    return filled.select("volume_id", "z", F.lit(24).alias("h"), F.lit(24).alias("w"), _dense("cells", 1728).alias("data"))


EVENT_RGB_SQL = """rgb_sums AS (SELECT CAST(user_id//24 AS INT) AS volume_id, CAST(day(ts)-1 AS INT) AS z, CAST(hour(ts) AS INT) AS x, CAST(user_id%24 AS INT) AS y,
CASE WHEN event_type IN ('view','signup') THEN 0 WHEN event_type IN ('click','error') THEN 1 ELSE 2 END AS ch, round(sum(value),6) AS s FROM events GROUP BY ALL),
rgb_grid AS (SELECT volume_id, z, CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, CAST(c.range AS INT) AS ch FROM (SELECT DISTINCT volume_id, z FROM rgb_sums), range(0,24) a, range(0,24) b, range(0,3) c),
event_rgb AS (SELECT g.*, coalesce(s/(s+50.0::DOUBLE),0) AS v FROM rgb_grid g LEFT JOIN rgb_sums USING (volume_id, z, x, y, ch))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB bag in [0, 1]; ``n`` keeps the multiplicity key of the source row."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        ((F.col("l_quantity") - 1) / 49).alias("r"),
        (F.col("l_discount") / 0.1 + 0.0).alias("g"),
        (F.col("l_tax") / 0.08 + 0.0).alias("b"),
    )


PIXELS_SQL = """pixels AS (SELECT (l_quantity-1)/49 AS r, l_discount/0.1+0.0 AS g, l_tax/0.08+0.0 AS b FROM lineitem)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.slice("embedding", 1, 10).cast("array<double>").alias("logits"), "label"
    )


LOGITS_SQL = """logits AS (SELECT vec_id AS id, CAST(embedding[1:10] AS DOUBLE[]) AS logits, label FROM embeddings)"""


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten codes: the mean vector of each label, over the whole table."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("label").alias("code"), F.posexplode("embedding").alias("i", "e"))
    means = cells.groupBy("code", "i").agg(F.round(F.avg(F.col("e").cast("double")), 6).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "m")))
    return means.groupBy("code").agg(F.transform(ordered, lambda c: c["m"]).alias("c"))


CODEBOOK_SQL = """code_cells AS (SELECT label AS code, i, round(avg(CAST(embedding[i] AS DOUBLE)),6) AS m FROM (SELECT label, embedding, unnest(range(1,65)) AS i FROM embeddings) GROUP BY ALL),
codebook AS (SELECT code, list(m ORDER BY i) AS c FROM code_cells GROUP BY code)"""

NEAREST_SQL = (
    CODEBOOK_SQL
    + """,
dist AS (SELECT e.vec_id, e.label, k.code, list_sum(list_transform(range(1,65), lambda i: (CAST(e.embedding[i] AS DOUBLE)-k.c[i])*(CAST(e.embedding[i] AS DOUBLE)-k.c[i]))) AS d2 FROM embeddings e, codebook k),
assigned AS (SELECT vec_id, label, code, d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, code) AS rn FROM dist) WHERE rn=1)"""
)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query and key sides: slices 2k and 2k+1 of one stack; an odd last slice has no partner."""
    placed = stacked(spark, sf_dir)
    pair = F.shiftright("z", 1)
    sides = placed.select(
        F.when(F.col("z") % 2 == 0, "q").otherwise("k").alias("side"),
        F.col("volume_id").alias("image_id"),
        pair.alias("pos"),
        F.col("embedding").cast("array<double>").alias("f"),
    )
    depth = sizes(spark, sf_dir).select(F.col("volume_id").alias("image_id"), F.col("nz").alias("n"))
    return attach_small(sides, depth, ["image_id"]).where(F.col("pos") < F.floor(F.col("n") / 2)).drop("n")


FEATURES_SQL = """features AS (SELECT CASE WHEN z%2=0 THEN 'q' ELSE 'k' END AS side, label AS image_id, CAST(z//2 AS INT) AS pos, CAST(embedding AS DOUBLE[]) AS f
FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS z, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE z < n - n%2)"""


def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.slice(whole, 1, 32).alias("mean"), F.slice(whole, 33, 32).alias("logvar")
    )


POSTERIOR_SQL = """posterior AS (SELECT vec_id AS id, CAST(embedding[1:32] AS DOUBLE[]) AS mean, CAST(embedding[33:64] AS DOUBLE[]) AS logvar FROM embeddings)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.col("lang").alias("dir"),
            F.concat(F.lit("n"), (F.col("doc_id") % 97).cast("string"), F.lit(".tif")).alias("name"),
        )
        .distinct()
    )


FILES_SQL = """files AS (SELECT DISTINCT lang AS dir, 'n' || CAST(doc_id%97 AS VARCHAR) || '.tif' AS name FROM documents)"""


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("ID"),
        F.col("quality").cast("double").alias("left_score"),
        F.col("toxic").cast("double").alias("right_score"),
    )


SUBJECTS_SQL = """subjects AS (SELECT CAST(doc_id AS VARCHAR) AS ID, CAST(quality AS DOUBLE) AS left_score, CAST(toxic AS DOUBLE) AS right_score FROM labels)"""


def checkpoint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.concat(
                F.lit("logs/default/v"),
                F.col("user_id").cast("string"),
                F.lit("/checkpoints/epoch="),
                (F.dayofmonth("ts") * 3).cast("string"),
                F.lit(".ckpt"),
            ).alias("path")
        )
        .distinct()
    )


PATHS_SQL = """paths AS (SELECT DISTINCT 'logs/default/v' || CAST(user_id AS VARCHAR) || '/checkpoints/epoch=' || CAST(day(ts)*3 AS VARCHAR) || '.ckpt' AS path FROM events WHERE event_type='purchase')"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), "ts", "event_id", F.col("value").alias("v"), F.col("event_type").alias("name")
    )


SERIES_SQL = """series AS (SELECT user_id AS key, ts, event_id, value AS v, event_type AS name FROM events)"""
