"""Joins of aligned volumes, directories and subject tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions import text
from stratavox.scale import attach_small, rank_rows


def interleaved_pair(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Even and odd slices of each stack as two volumes on the same grid."""
    half = F.shiftright("z", 1)
    return (
        slices.where(F.col("z") % 2 == 0).withColumn("z", half),
        slices.where(F.col("z") % 2 == 1).withColumn("z", half),
    )


def slice_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("volume_id", "z")) -> DataFrame:
    """Equi-join of block rows: one row per aligned slice pair, so the shuffle moves slices and not voxels."""
    left = a.select(*keys, "h", "w", F.col("data").alias("a"))
    right = b.select(*keys, F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("data").alias("b"))
    same = (F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w"))
    checked = F.when(same, F.col("b")).otherwise(F.raise_error(F.lit("paired slices differ in shape")))
    return left.join(right, list(keys)).select(*keys, "h", "w", "a", checked.alias("b"))


def voxel_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("volume_id", "z")) -> DataFrame:
    """Aligned element-wise pairs ``a``, ``b`` per voxel."""
    zipped = slice_pairs(a, b, keys).select(*keys, "w", F.posexplode(F.arrays_zip("a", "b")).alias("_i", "p"))
    return zipped.select(
        *keys,
        F.expr("CAST(_i DIV w AS INT)").alias("x"),
        F.expr("CAST(_i % w AS INT)").alias("y"),
        "p.a",
        "p.b",
    )


def stack_two_channels(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("volume_id", "z")) -> DataFrame:
    return voxel_pairs(a, b, keys).select(*keys, "x", "y", F.array("a", "b").alias("channels"))


def select_channel(stacked: DataFrame, channel: int = 0, value: str = "v") -> DataFrame:
    return stacked.withColumn(value, F.col("channels")[channel]).drop("channels")


def common_names(files: DataFrame, directories: int) -> DataFrame:
    """Names present in every directory: one shuffle, however many directories there are."""
    return (
        files.groupBy("name").agg(F.countDistinct("dir").alias("_d")).where(F.col("_d") == directories).select("name")
    )


def paired_samples(files: DataFrame, dirs: Sequence[str]) -> DataFrame:
    """One row per common name with the path of every directory, in direction order."""
    path = F.concat_ws("/", "dir", "name")
    wide = files.where(F.col("dir").isin(*dirs)).groupBy("name").agg(
        *[F.max(F.when(F.col("dir") == d, path)).alias(d) for d in dirs]
    )
    present = wide.where(" AND ".join(f"`{d}` IS NOT NULL" for d in dirs))
    return present.select("name", F.array(*[F.col(d) for d in dirs]).alias("filenames"))


def subject_labels(samples: DataFrame, subjects: DataFrame, path: str = "path") -> DataFrame:
    """Two scores per file by subject key; difference / 10 and its sign as 0, .5, 1. A missing subject is an error.

    ``subjects`` needs ``ID, left_score, right_score`` and may carry ``ord`` to say which duplicate comes first;
    without it the smallest pair of scores does.
    """
    order = F.col("ord") if "ord" in subjects.columns else F.struct("left_score", "right_score")
    first = subjects.groupBy("ID").agg(F.min_by(F.struct("left_score", "right_score"), order).alias("s"))
    looked = samples.withColumn("ID", text.subject_key(F.col(path))).join(first, "ID", "left")
    found = F.when(F.col("s").isNull(), F.raise_error(F.concat(F.lit("unknown subject "), F.col("ID")))).otherwise(F.col("s"))
    scored = looked.withColumn("s", found)
    diff = (F.col("s.right_score") - F.col("s.left_score")) / 10
    return scored.select(
        path,
        "ID",
        F.col("s.left_score").alias("left_score"),
        F.col("s.right_score").alias("right_score"),
        diff.alias("diff"),
        ((F.signum(diff) + 1) / 2).alias("binary"),
    )


def name_positions(names: DataFrame, order: Sequence[str] = ("name",), keys: Sequence[str] = ()) -> DataFrame:
    """0-based place (long) of each row in sorted order."""
    return rank_rows(names, keys, order, "pos")


def select_indices(names: DataFrame, positions: DataFrame) -> DataFrame:
    """Keep the rows at the listed positions of the sorted list."""
    return attach_small(name_positions(names), positions.select("pos").distinct(), ["pos"], "left_semi")
