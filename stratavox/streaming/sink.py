"""Run a stream over the files present and read back what it appended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratavox.session import ROCKSDB, ensure_checkpoint_dir


def read_files(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """File stream of one table, a file or a folder of files; the schema is read once from the files."""
    schema: T.StructType = spark.read.parquet(f"{folder}/{name}").schema
    # As a glob the path may be a file, or a folder whose files are listed at every trigger.
    path = name if set(name) & set("*?[{") else f"{{{name}}}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{path}")


def run_available(stream: DataFrame) -> DataFrame:
    """Append mode, all available input, Parquet files in the shared folder."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    run = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out")
