"""Run the registered queries next to their DuckDB SQL and compare the results.

    python check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from workload.oracles import ORACLES
from workload.queries import QUERIES


def local_session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        name = file.split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if the tables agree in names, kinds and values, whatever the row order."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = _sorted(got), _sorted(want)
    for c in got.columns:
        if got[c].dtype.kind != want[c].dtype.kind or (
            got[c].dtype.kind == "i" and got[c].dtype != want[c].dtype
        ):
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"
        differs = ~((got[c] == want[c]) | (got[c].isna() & want[c].isna()))
        if differs.any():
            at = differs.idxmax()
            return f"{differs.sum()} values of {c}, e.g.\n{got.loc[at].to_dict()}\n{want.loc[at].to_dict()}"
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        got = QUERIES[name](spark, sf_dir).toPandas()
        middle = time.time()
        problem = "no SQL" if name not in ORACLES else difference(got, con.execute(ORACLES[name]).df())
        bad += problem is not None
        print(f"{name:30} {problem or 'ok':6} rows {len(got)} spark {middle - start:.2f}s duckdb {time.time() - middle:.2f}s", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
