"""Image catalogs, patch sinks and tables that surround the volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.functions import text
from stratavox.operators import tiling
from stratavox.scale import attach_small, rank_rows

# Accepted image suffixes, case as listed.
IMAGE_SUFFIXES = (".jpg", ".JPG", ".jpeg", ".JPEG", ".png", ".PNG", ".ppm", ".PPM", ".bmp", ".BMP", ".tif")


def is_image(path: Column, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> Column:
    pattern = "(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$"
    return path.rlike(pattern)


def image_catalog(spark: SparkSession, root: str, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Recursive sorted listing of image files; only metadata is read. An empty listing is an error."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
        .where(is_image(F.col("path"), suffixes))
    )
    if found.limit(1).count() == 0:
        raise FileNotFoundError(f"{root} has no image file")
    return found.orderBy("path")


def sorted_paths(df: DataFrame, path: str = "path") -> DataFrame:
    return df.select(path).distinct().orderBy(path)


def slices_to_volume(slices: DataFrame, id_col: str) -> DataFrame:
    """Stack slices in the order of their ids (numbers or text); all slices of a volume must have one shape. ``z`` is long."""
    shapes = slices.groupBy("volume_id").agg(
        F.min(F.struct("h", "w")).alias("_least"), F.max(F.struct("h", "w")).alias("_most")
    )
    stacked = attach_small(rank_rows(slices, ["volume_id"], [id_col], "z"), shapes, ["volume_id"])
    same = F.col("_least") == F.col("_most")
    checked = F.when(same, F.col("z")).otherwise(F.raise_error(F.lit("slices of a volume differ in shape")))
    return stacked.withColumn("z", checked).drop("_least", "_most")


def write_patches(patches: DataFrame, root: str, dest: str, mode: str = "append") -> None:
    """One row per named patch, single precision, one folder per destination."""
    out = patches.withColumn("data", F.col("data").cast("array<float>")).withColumn("dest", F.lit(dest))
    out.write.mode(mode).partitionBy("dest").parquet(root)


def split_imageset(images: DataFrame, p_size: int, p_overlap: int, p_max: int) -> DataFrame:
    """Overlap tiles of every catalogued image with their file names."""
    stem = F.regexp_replace(text.base_name(F.col("path")), r"\.[^.]*$", "")
    tiles = tiling.tile_overlap(images.where(is_image(F.col("path"))), p_size, p_overlap, p_max)
    return tiles.withColumn("name", text.tile_name(stem, F.col("i")))


SUBJECT_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("left_score", T.DoubleType()),
        T.StructField("right_score", T.DoubleType()),
    ]
)


def subject_scan(spark: SparkSession, path: str, schema: T.StructType = SUBJECT_SCHEMA) -> DataFrame:
    """CSV of subject scores, id kept as text."""
    return spark.read.csv(path, header=True, schema=schema)


def subject_rows(lines: DataFrame, line: str = "line", schema: T.StructType = SUBJECT_SCHEMA) -> DataFrame:
    """The same parse for CSV lines that already are rows of a table or stream."""
    return lines.select(F.from_csv(F.col(line), schema.simpleString()[7:-1].replace(":", " ")).alias("s")).select("s.*")


def with_epoch(metrics: DataFrame, epoch: int | Column) -> DataFrame:
    epoch = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return metrics.select(epoch.alias("epoch"), *metrics.columns)


def append_epoch_metrics(metrics: DataFrame, epoch: int, path: str) -> None:
    """Plain CSV rows at the end of a log; calling it twice doubles the rows (``put_epochs`` does not)."""
    with_epoch(metrics, epoch).write.mode("append").csv(path, header=True)


def put_epochs(metrics: DataFrame, path: str) -> None:
    """Metrics with an ``epoch`` column as CSV, a folder per epoch. An epoch written again replaces itself, others stay: a
    retried or repeated append does not double rows.
    """
    writer = metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
    writer.partitionBy("epoch").csv(path)


def read_epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``put_epochs`` wrote, all epochs; ``schema`` names the columns but ``epoch``, which is an int."""
    return spark.read.option("header", True).schema(f"{schema}, epoch int").csv(path)


def stale_runs(paths: DataFrame, runs: DataFrame | None = None, min_epoch: int = 60) -> DataFrame:
    """Runs whose last checkpoint path (in text order) has an epoch below ``min_epoch``; runs without one count as 0."""
    last = (
        paths.withColumn("run", text.run_folder(F.col("path")))
        .groupBy("run")
        .agg(F.max_by(text.checkpoint_epoch(F.col("path")), F.col("path")).alias("epoch"))
    )
    if runs is not None:
        last = runs.join(last, "run", "left").withColumn("epoch", F.coalesce("epoch", F.lit(0)))
    return last.where(F.col("epoch") < min_epoch).select("run", "epoch")


def split_scan(spark: SparkSession, root: str, split: str) -> DataFrame:
    """One split of a table stored with a ``split=`` folder level; a missing split gives no rows."""
    return spark.read.parquet(root).where(F.col("split") == split)
