"""Session defaults and the one way this library cuts lineage.

Results that several jobs read (a feature table that feeds a Gram pass and a
scoring pass, the state of an iterative replay) are written as parquet to the
shared folder the cluster names in ``spark.checkpoint.dir``. Unlike a cached or
locally checkpointed frame such a table survives the loss of any executor, and
it keeps column pruning and filter pushdown for its readers.
"""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Runtime settings the plans are written for. Wall-clock times are read as UTC,
# also where a stream needs a timestamp with time zone. The JVM never compiles methods
# above 8,000 bytes of bytecode; beyond that, projections split into small
# methods run faster than one whole stage that stays interpreted.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Stream sessions merge before the shuffle, so a hot child sends few rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def ship_by_value(module: str) -> None:
    """Send a module's task functions with the task itself.

    Executors then need no installed copy of this package. A module that a task
    function names is sent with all it has imported, so this one is sent as well.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, app_name: str = "diurna", **conf: str) -> SparkSession:
    """SparkSession with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        # The call site of every column expression costs more than building it.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **RUNTIME_SETTINGS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's own setting wins.

    Only where the setting is absent (tests, a laptop) a temporary folder is
    made, and the session remembers it.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    remembered = spark.conf.get("diurna.workspace", None)
    if remembered is None:
        remembered = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("diurna.workspace", remembered)
    return remembered


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the workspace; nothing is ever overwritten."""
    return f"{workspace_dir(spark)}/diurna-{label}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the workspace and return a scan of it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ship_by_value(__name__)
