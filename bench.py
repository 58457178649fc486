"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "a9_column_profile",
    "a9_array_profile",
    "a13_label_products",
    "a14_gram_columns",
    "a14_gram_blocks",
    "a17_weighted_products",
    "p4_standardize_all",
    "m5_path",
    "m5_path_folds",
    "m5_path_blocks",
    "m5_path_lazy",
    "m7_fit_many",
    "m10_transform",
    "m11_logistic_path",
    "m16_cross_validation",
    "m17_regression_metrics",
)


def wide_rows(spark, sf_dir: str, table: str, key: str, width: int):
    """Hashed features for the rows of a table."""
    from ridgeline.sources.synthetic import synthetic_rows

    ids = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key)
    return synthetic_rows(ids, key, width, weights=[1.0, -0.5, 0.25] + [0.0] * (width - 3))


def path_1000(spark, sf_dir: str):
    from ridgeline import elastic_net_path

    return elastic_net_path(wide_rows(spark, sf_dir, "part", "p_partkey", 1000), "label", "features", [0.9], num_lambdas=20)


def path_10000_lazy(spark, sf_dir: str):
    from ridgeline import lazy_path

    return lazy_path(wide_rows(spark, sf_dir, "supplier", "s_suppkey", 10000), "label", "features", [0.9], num_lambdas=10, lambda_shrink=0.3)


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    from ridgeline import get_session
    from verification.queries import all_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries() | {"path_1000": path_1000, "path_10000_lazy": path_10000_lazy}
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):  # start the JVM's compilers and the Python workers outside the timing
        queries["m5_path_blocks"](spark, warm).collect()
    seconds = {}
    wide = ("path_1000", "path_10000_lazy") if os.environ.get("BENCH_WIDE") else ()  # these take minutes
    for name in (*HEADLINE, *wide):
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
