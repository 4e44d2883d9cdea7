"""Streaming ingest of intervention responses: check, deduplicate, append.

Each micro-batch is committed to a folder of its own, named by its number and cut by
month. A batch that is run again replaces its folder, so a rerun adds no line. A record
is a duplicate if its id, a digest of the record, is in the history already: only the
months that a batch touches are looked at, whatever their age, so no record is too late
and no state grows with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from diurna.plans import interventions
from diurna.schemas import INTERVENTION_RECORD
from diurna.sources.files import has_files

UNDATED = "1970-01-01"


def commit(responses: DataFrame, batch: int, path: str, rejected: str) -> None:
    """Write the new records of one batch to ``path``, the refused ones to ``rejected``.

    Valid responses become one line per record that the history does not hold; refused
    ones keep their columns and say why. Records without a time are kept under 1970.
    """
    spark = responses.sparkSession
    stamped = responses.withColumn("event_time", F.col("event_time").cast("timestamp"))
    stamped = stamped.persist()
    try:
        refused = interventions.checked_records(stamped).where("reject_reason IS NOT NULL")
        refused.write.mode("overwrite").json(f"{rejected}/batch={batch}")
        month = F.coalesce(F.trunc(F.to_date("event_time"), "month"), F.lit(UNDATED).cast("date"))
        records = (
            interventions.build_records(stamped, keep_time=True)
            .withColumn("month", month)
            .drop("event_time")
            .dropDuplicates(["intervention_id"])
        )
        if has_files(spark, path):
            span = records.agg(F.min("month").alias("first"), F.max("month").alias("last")).first()
            known = (
                spark.read.schema("intervention_id string, batch long, month date")
                .json(path)
                .where(F.col("month").between(F.lit(span["first"]), F.lit(span["last"])))
                .where(F.col("batch") != batch)
            )
            records = records.join(known, ["month", "intervention_id"], "left_anti")
        columns = [f.name for f in INTERVENTION_RECORD.fields]
        (
            records.select(*columns, "month")
            .write.mode("overwrite")
            .partitionBy("month")
            .option("ignoreNullFields", False)
            .json(f"{path}/batch={batch}")
        )
    finally:
        stamped.unpersist()


def ingest(responses: DataFrame, path: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Append what a response stream brings to the history, then stop."""
    return (
        responses.writeStream.foreachBatch(lambda rows, batch: commit(rows, batch, path, rejected))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
