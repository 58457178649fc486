"""Run the queries against their SQL twins and report mismatches."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def normalized(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def mismatch(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """None when both frames hold the same rows with equal values and types."""
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} / {sorted(expected.columns)}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows / {len(expected)}"
    a, e = normalized(actual), normalized(expected)
    for name in a.columns:
        if a[name].dtype != e[name].dtype:
            return f"{name}: type {a[name].dtype} / {e[name].dtype}"
        different = (a[name] != e[name]) & ~(a[name].isna() & e[name].isna())
        if different.any():
            i = different.idxmax()
            return f"{name}: {int(different.sum())} values, first {a[name][i]!r} / {e[name][i]!r}"
    return None


def main(names: list[str]) -> None:
    from ridgeline import get_session
    from verification.oracles import all_oracles
    from verification.queries import all_queries

    sf_dir = "/root/testdata/sf0.01"
    spark = get_session("compare", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    oracles = all_oracles()
    for name, query in all_queries().items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            actual = query(spark, sf_dir).toPandas()
            middle = time.time()
            problem = "no oracle" if name not in oracles else mismatch(actual, connection.execute(oracles[name]).df())
        except Exception as error:  # noqa: BLE001 - report and go on
            actual, middle, problem = pd.DataFrame(), time.time(), f"{type(error).__name__}: {str(error)[:1500]}"
        end = time.time()
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={len(actual)} spark={middle - begin:.1f}s sql={end - middle:.1f}s {problem or ''}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
