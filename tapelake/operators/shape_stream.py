"""Time shapes of days as they are published: a stream over a store's versions into a table keyed by batch.

The stream's source is the log of versions, a file a version. Each batch takes the last version it was given, finds the days whose
run no earlier batch has recorded, and writes their histogram to the folder of its own number. A batch that runs again, because a
job died before the batch was noted in the checkpoint, replaces that folder, so every published day is counted once.

Days that no version names, those in plain folders, are not streamed: ``audit.append_time_shapes`` is for them.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.functions.names import day_folder
from tapelake.operators.audit import time_shapes
from tapelake.schema import STREAMS, TIME_COL
from tapelake.session import qualified, small_frame
from tapelake.sources.files import path_exists
from tapelake.sources.raw_store import scan_containers
from tapelake.sources.snapshots import log_folder, snapshot

_RECORDED = "run string, day date, stream string, len int, count bigint, batch bigint"


def _recorded(spark: SparkSession, out: str) -> DataFrame:
    """What the batches have written; none where there is no table."""
    if not path_exists(spark, out):
        return small_frame(spark, [], _RECORDED)
    return spark.read.schema(_RECORDED).option("basePath", out).parquet(out)


def _record(batch: DataFrame, number: int, root: str, out: str) -> None:
    """Write the histogram of the days that the batch's last version publishes and no earlier batch has recorded."""
    spark = batch.sparkSession
    last = batch.agg(F.max_by("runs", "version").alias("runs"))
    published = last.select(F.explode("runs").alias("day", "run")).select(F.col("day").cast("date").alias("day"), "run")
    earlier = _recorded(spark, out).filter(F.col("batch") < number).select("day", "run").distinct()
    days: dict[str, list[dt.date]] = {}
    for r in published.join(earlier, ["day", "run"], "left_anti").collect():
        days.setdefault(r["run"], []).append(r["day"])
    parts = [scan_containers(spark, [day_folder(f"{root}/{s}", run, d) for d in own], [TIME_COL])
             .select("day", F.lit(s).alias("stream"), TIME_COL) for run, own in sorted(days.items()) for s in STREAMS]
    if parts:
        rows = reduce(DataFrame.unionByName, parts)
        runs = small_frame(spark, [(d, run) for run, own in days.items() for d in own], "day date, run string")
        time_shapes(rows).join(runs, "day").select("run", "day", "stream", "len", "count") \
            .write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")


def stream_time_shapes(spark: SparkSession, root: str, out: str, checkpoint: str) -> None:
    """Bring the table ``out`` up to the store's last version and end; ``checkpoint`` must stay with the table."""
    base = qualified(spark, root).rstrip("/")
    versions = spark.readStream.schema("runs map<string, string>").option("multiLine", True).option("mode", "FAILFAST") \
        .json(log_folder(spark, root)).select("runs", F.col("_metadata.file_name").alias("version"))
    started = versions.writeStream.foreachBatch(lambda batch, number: _record(batch, number, base, out)) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()


def streamed_shapes(spark: SparkSession, root: str, out: str) -> DataFrame:
    """(day, stream, len, count) of the runs that the store's last version names, as far as they are recorded."""
    current = small_frame(spark, list(snapshot(spark, root).runs.items()), "day date, run string")
    return _recorded(spark, out).join(current, ["day", "run"], "left_semi").select("day", "stream", "len", "count")
