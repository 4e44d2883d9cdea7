"""Run a stream over what is there, to a table, and hand the table back."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from diurna.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State beyond the heap, needed by arbitrary stateful operators."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def finish(query: StreamingQuery) -> None:
    """Wait for an available-now query; re-raises its failure."""
    query.awaitTermination()
    error = query.exception()
    if error is not None:
        raise error


def drained(stream: DataFrame, label: str, mode: str = "append") -> tuple[DataFrame, list[dict]]:
    """Process all available input; the result as a table, and the progress reports.

    Append goes to a parquet sink. Complete results are written by
    foreachBatch, the last one counts.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    reports = _run(stream, path, checkpoint, mode)
    return spark.read.schema(stream.schema).parquet(path), reports


def _run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> list[dict]:
    writer = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
    )
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    finish(query)
    return [json.loads(p.json) for p in query.recentProgress]


def drained_to_end(
    log: DataFrame, end: DataFrame, job: Callable[[DataFrame], DataFrame], label: str
) -> tuple[DataFrame, list[dict]]:
    """Process all of ``log`` by ``job``, open windows too; with the progress reports.

    In append mode a window comes out once the watermark has passed it, so those of a
    log's last days would stay in the state. When the log has been read to its end, the
    row ``end`` (like a row of the log, later than any) is read in a second run on the
    same checkpoint: it moves the watermark past all that is open, and as nothing
    comes after it, makes nothing late. Only its own window is left in the state.
    """
    spark = log.sparkSession
    ends = scratch_path(spark, f"{label}-end")
    end.limit(0).write.parquet(ends)
    stream = job(log.unionByName(spark.readStream.schema(log.schema).parquet(ends)))
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    reports = _run(stream, path, checkpoint)
    end.write.mode("append").parquet(ends)
    reports += _run(stream, path, checkpoint)
    return spark.read.schema(stream.schema).parquet(path), reports


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process all available input and return the result as a table."""
    return drained(stream, label, mode)[0]


def late_rows(reports: list[dict]) -> int:
    """Rows that came after their window was closed and were left out."""
    return sum(op["numRowsDroppedByWatermark"] for r in reports for op in r["stateOperators"])


def state_rows(reports: list[dict]) -> list[int]:
    """Rows kept in state after each batch."""
    return [sum(op["numRowsTotal"] for op in r["stateOperators"]) for r in reports]
