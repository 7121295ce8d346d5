"""Seeded sampling and batching. Every choice is a rank of a keyed draw, so retries and partitioning change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavox.functions import draws
from stratavox.scale import attach_small, prefix_sum


def shuffle_batches(df: DataFrame, id_col: str, size: int, seed: int, drop_last: bool = False) -> DataFrame:
    """Random order cut into batches; the rank is a distributed running count, not a window over all rows."""
    drawn = df.select(id_col).withColumns({"_u": draws.uniform(seed, "shuffle", F.col(id_col)), "_all": F.lit(1)})
    out = prefix_sum(drawn, ["_all"], ["_u", id_col], {}, rank="_rank", totals_of={"_n": "_rank"})
    pos = F.col("_rank") - 1
    if drop_last:
        out = out.where(pos < F.col("_n") - F.col("_n") % size)
    return out.select(
        id_col, F.floor(pos / size).cast("int").alias("batch"), (pos % size).cast("int").alias("place")
    )


def sample_positions(features: DataFrame, n: int, seed: int, layer: int = 0) -> DataFrame:
    """Keep ``n`` positions without replacement, equal for all images and sides; per ``layer`` if there is such a column.

    The n smallest keyed draws over the distinct positions: a rank limit, so each task forwards at most n rows per layer.
    """
    keys = ["layer", "pos"] if "layer" in features.columns else ["pos"]
    which = F.col("layer") if "layer" in features.columns else F.lit(layer)
    places = features.select(*keys).distinct().withColumn("_u", draws.uniform(seed, "positions", which, F.col("pos")))
    if "layer" in features.columns:
        rank = F.row_number().over(Window.partitionBy("layer").orderBy("_u", "pos"))
        chosen = places.withColumn("_r", rank).where(F.col("_r") <= n).select(*keys)
    else:
        chosen = places.orderBy("_u", "pos").limit(n).select(*keys)
    return attach_small(features, chosen, keys, "left_semi")
