"""Runs queries against their SQL: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted((tuple(map(_plain, row)) for row in rows), key=repr)


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def differences(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[int, list]:
    got = canonical(QUERIES[name](spark, sf_dir).toPandas())
    if name not in ORACLE:
        return len(got), []
    want = canonical(con.sql(ORACLE[name]).df())
    wrong = [pair for pair in zip(got, want) if pair[0] != pair[1]]
    if len(got) != len(want):
        wrong.insert(0, (f"{len(got)} rows", f"{len(want)} rows"))
    return len(got), wrong


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            rows, wrong = differences(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            rows, wrong = -1, [(type(error).__name__, str(error)[:1500])]
        failed += bool(wrong)
        mark = "DIFF" if wrong else ("ok" if name in ORACLE else "rows")
        print(f"{mark:5}{name:34}{rows:8} rows {time.time() - start:6.1f} s", flush=True)
        for pair in wrong[:3]:
            print("     spark ", pair[0], "\n     sql   ", pair[1], flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
