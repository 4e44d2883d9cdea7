"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream_table(
    spark: SparkSession,
    folder: str,
    name: str,
    schema: StructType,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A table as a stream of its part files.

    A table of many part files is a folder and is streamed as such. A table
    that is one file is picked by its name from the folder it lies in, since a
    stream can only watch folders. ``files_per_trigger`` is for files that
    arrive in time order; a table whose files are in any order belongs in one
    trigger, or its later files would count as late.
    """
    file = f"{name}.parquet"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    parts = spark.read.schema(schema).parquet(f"{folder}/{file}").inputFiles()
    if [p.rsplit("/", 1)[-1] for p in parts] == [file]:
        return reader.option("pathGlobFilter", file).parquet(folder)
    return reader.parquet(f"{folder}/{file}")
