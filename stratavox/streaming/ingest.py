"""New slice files -> rescale by stored volume statistics -> plane tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions import pixel
from stratavox.operators.codebook import slice_tiles
from stratavox.scale import attach_small


def ingest_tiles(slices: DataFrame, stats: DataFrame, tile: int) -> DataFrame:
    """``stats`` (volume_id, p_lo, p_hi) is a table, kept by a batch job: whole-volume percentiles cannot come from the stream."""
    scaled = attach_small(slices, stats, ["volume_id"]).withColumn(
        "data",
        F.transform(
            "data",
            lambda v: pixel.signed_range(pixel.clip(v, F.col("p_lo"), F.col("p_hi")), F.col("p_lo"), F.col("p_hi")),
        ),
    )
    return slice_tiles(scaled, tile)
