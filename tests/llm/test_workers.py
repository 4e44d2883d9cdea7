"""Every corpus query with Python workers that have no copy of the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from diurna.session import build_session
from diurna.llm import queries

spark = build_session("local[4]", **{"spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("OFF")

@queries.F.arrow_udf("boolean")
def there(column: queries.packing.pa.Array) -> queries.packing.pa.Array:
    import importlib.util
    import pyarrow as pa
    return pa.array([importlib.util.find_spec("diurna") is not None] * len(column))

assert not spark.range(1).select(there("id")).first()[0], "workers have a copy"
for name, query in queries.QUERIES.items():
    try:
        query(spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
    except Exception as err:
        print("FAILED", name, str(err)[-600:], flush=True)
print("done")
"""


def test_workers_need_no_copy(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env |= {"PYSPARK_PYTHON": sys.executable, "PYTHONDONTWRITEBYTECODE": "1"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(REPO), sf_dir],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900,
    )
    assert "FAILED" not in run.stdout and run.stdout.strip().endswith("done"), (
        run.stdout[-3000:] + run.stderr[-1000:]
    )
