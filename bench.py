"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and once timed, into a sink that takes every row. ``decode_90m`` decodes one integer
column of ninety million values, ``replay_90m`` only produces them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapelake.functions import to_int64  # noqa: E402
from tapelake.plans.queries import QUERIES  # noqa: E402
from tapelake.session import prepare  # noqa: E402

HEADLINE = ("typed_scan", "typed_scan_session", "store_read_session", "store_read_symbols", "store_quotes", "store_gaps",
            "footer_catalog", "decode_int_shapes", "decode_time_lengths", "short_time_days", "time_shape_histogram",
            "symbol_stream_differences", "copy_compare", "registry_defect_codes", "registry_snapshot_problems",
            "ingest_receipts", "ingest_row_counts", "canonical_digests", "digest_rollup")


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line item prices as text, repeated until there are ninety million."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    copies = max(1, round(90_000_000 / rows.count()))
    text = rows.select(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string").alias("v"))
    return text.repartition(spark.sparkContext.defaultParallelism).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))


def _run(df: DataFrame) -> float:
    start = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = prepare(SparkSession.builder.master(f"local[{cpus}]").appName("bench")
                    .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
                    .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
                    .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.monotonic()
            _run(QUERIES[name](spark, sf_dir))
            seconds[name] = round(time.monotonic() - start, 3)
    values = _replayed(spark, sf_dir)
    for name, df in (("replay_90m", values.select("v")), ("decode_90m", values.select(to_int64("v").alias("v")))):
        _run(df)
        seconds[name] = round(_run(df), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
