"""CSV tables, dataset discovery and the JSON-lines event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from diurna.schemas import INTERVENTION_RECORD


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Headered CSV. Give a schema at volume; inference reads the data twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headered CSV, one file per partition, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def _children(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [str(s.getPath().toString()) for s in fs.listStatus(path)]
    return sorted(n for n in names if n.endswith(suffix))


def has_files(spark: SparkSession, folder: str) -> bool:
    return bool(_children(spark, folder, ""))


def discover_csv(spark: SparkSession, folder: str, required: Sequence[str]) -> str:
    """First CSV (by path) whose header has all required columns.

    Only headers are read; unreadable entries are passed over.
    """
    for path in _children(spark, folder, ".csv"):
        try:
            header = spark.read.option("header", True).csv(path).limit(0).columns
        except (AnalysisException, PySparkException):
            continue
        if set(required) <= set(header):
            return path
    raise FileNotFoundError(f"no CSV in {folder} has the columns {sorted(required)}")


def append_records(records: DataFrame, path: str) -> None:
    """Append history records as JSON lines (arrays as arrays, UTF-8 text)."""
    columns = [f.name for f in INTERVENTION_RECORD.fields]
    records.select(*columns).write.mode("append").option("ignoreNullFields", False).json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """History records, from plain files or from folders of batches and months."""
    columns = [f.name for f in INTERVENTION_RECORD.fields]
    return spark.read.schema(INTERVENTION_RECORD).json(path).select(*columns)
