"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.session import ensure_checkpoint_dir

#: The six white-space characters that the contracts name.
SPACES = " \t\n\x0b\x0c\r"
#: Spark's setting that removes a query's shuffle files when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, every other character unchanged; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str | None = None, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    With ``release`` the shuffle files behind ``df`` go as soon as it is written.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    if release:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if release:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Take the files of a ``stored`` frame that no later step reads: an empty table is written over them."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(unquote(files[0]).rsplit("/", 1)[0])


def total_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column, from a scan of that column."""
    return df.agg(F.sum(F.octet_length(text_col))).head()[0] or 0


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers live on between tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
