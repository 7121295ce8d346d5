"""Block rows (one array per slice) and long voxels, and the moves between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.scale import attach_small


def slices_to_voxels(slices: DataFrame, value: str = "v") -> DataFrame:
    """Explode block rows; coordinates are arithmetic on the array position, so nothing is ranked."""
    keep = [c for c in slices.columns if c not in ("data", "h", "w")]
    return slices.select(*keep, "w", F.posexplode("data").alias("_i", value)).select(
        *keep,
        F.expr("CAST(_i DIV w AS INT)").alias("x"),
        F.expr("CAST(_i % w AS INT)").alias("y"),
        value,
    )


def voxels_to_slices(voxels: DataFrame, keys: list[str] | None = None, value: str = "v") -> DataFrame:
    """Gather one plane per row. A group is a single plane, the unit one image file holds."""
    keys = keys or ["volume_id", "z"]
    cells = F.sort_array(F.collect_list(F.struct("x", "y", F.col(value).alias("v"))))
    return voxels.groupBy(*keys).agg(
        (F.max("x") + 1).alias("h"), (F.max("y") + 1).alias("w"), F.transform(cells, lambda c: c["v"]).alias("data")
    )


def x_windows(
    slices: DataFrame, rows: int, ghost: int, values: Sequence[str] = ("data",), sizes: DataFrame | None = None, before: int | None = None
) -> DataFrame:
    """Planes (Z, Y) along X, cut along z in windows of ``rows`` slices with up to ``ghost`` neighbours on either side, or ``before`` of
    them on the lower side.

    One row per (volume_id, x, window): ``z_from`` and ``h`` say which slices it holds, ``nz`` how deep the volume is. Plane rows
    move through the shuffle, each to the windows that need it, and a group never exceeds rows + 2 ghost of them, however
    deep the volume. ``sizes`` (volume_id, nz) saves a pass over z. A missing slice raises an error.
    """
    depth = sizes.select("volume_id", "nz") if sizes is not None else slices.groupBy("volume_id").agg((F.max("z") + 1).alias("nz"))
    z, nz, before = F.col("z"), F.col("nz"), ghost if before is None else before
    at = lambda place: F.floor(place / rows).cast("int")
    first, last = at(F.greatest(z - ghost, F.lit(0))), at(F.least(z + before, nz - 1))
    placed = attach_small(slices, depth, ["volume_id"]).withColumn("window", F.explode(F.sequence(first, last)))
    cells = placed.select("volume_id", "z", "nz", "w", "window", *values, F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("x"))
    part = F.struct("z", *[F.slice(v, F.col("x") * F.col("w") + 1, F.col("w")).alias(v) for v in values])
    gathered = cells.groupBy("volume_id", "x", "w", "nz", "window").agg(F.sort_array(F.collect_list(part)).alias("rs"))
    begin = F.greatest(F.col("window") * rows - before, F.lit(0))
    end = F.least((F.col("window") + 1) * rows + ghost, nz)
    whole = F.size("rs") == end - begin
    return gathered.select(
        "volume_id",
        "x",
        "window",
        "nz",
        begin.alias("z_from"),
        F.when(whole, F.size("rs")).otherwise(F.raise_error(F.lit("slices are missing")).cast("int")).alias("h"),
        "w",
        *[F.flatten(F.col(f"rs.{v}")).alias(v) for v in values],
    )
