"""Run registered queries against their DuckDB oracles.

    python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if value != value else round(value + 0.0, 6)
    return value


def _kind(value):
    return "null" if value is None else type(value).__name__


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    cells.sort(key=lambda r: tuple((v is None, str(type(v)), v) for v in r))
    return [columns[i] for i in order], cells


def compare(spark_df, con, sql):
    """None when equal, else a short description of the difference."""
    got_cols, got = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = table_of(names, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:3]} duckdb {want[:3]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. spark {bad[0][0]} duckdb {bad[0][1]}"
    for i, name in enumerate(got_cols):
        kinds = ({_kind(r[i]) for r in got} - {"null"}, {_kind(r[i]) for r in want} - {"null"})
        if kinds[0] != kinds[1]:
            return f"type of {name}: {kinds}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from diurna.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                note = "ok" if problem is None else f"FAIL {problem}"
            else:
                note = f"rows {len(df.collect())}"
        except Exception as err:  # noqa: BLE001
            note = f"FAIL {type(err).__name__}: {str(err)[:1500]}"
        failed += note.startswith("FAIL")
        print(f"{name:28s} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
