"""Run records named by their content, in a log that several writers may append to.

A batch of records is written aside, below ``{log}/batch=ID``, where nobody looks. ``{log}/_versions`` numbers the batches: a batch
becomes part of the log by one rename to the next number, which fails if another writer took it. That writer's records are then
read and the batch is judged again, so no id comes in twice, and a job that dies before its rename has added nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.session import qualified, small_frame
from tapelake.sources.files import remove_folder
from tapelake.sources.snapshots import claim, contents

RECORD = "receipt_id string, body string, written_at timestamp"


class RecordConflict(RuntimeError):
    """A recorded id has another body now."""


def run_records(runs: DataFrame, columns: list[str]) -> DataFrame:
    """(receipt_id, body): each run as JSON with its keys in order, and that text's digest. Equal content, equal id."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return runs.select(F.sha2(body, 256).alias("receipt_id"), body.alias("body")).distinct()


def record_conflicts(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Records whose id is taken by another body, and stored records whose body no longer gives their id."""
    clash = records.alias("n").join(existing.alias("o"), "receipt_id").filter("n.body <> o.body").select("receipt_id")
    broken = existing.filter(F.sha2("body", 256) != F.col("receipt_id")).select("receipt_id")
    return clash.unionByName(broken).distinct()


def log_records(spark: SparkSession, log: str, upto: int | None = None) -> DataFrame:
    """The records of a log, or of its first ``upto`` batches; none where there is no log."""
    batches = contents(spark, log)[:upto]
    if not batches:
        return small_frame(spark, [], RECORD)
    base = qualified(spark, log).rstrip("/")
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json([f"{base}/batch={b['batch']}" for b in batches])


def append_records(records: DataFrame, log: str) -> DataFrame:
    """Add the records the log lacks; raise when one is there with another body. Returns the log.

    Another writer may append meanwhile, the same records too: each id is in the log once.
    """
    spark = records.sparkSession
    while True:
        known = len(contents(spark, log))
        existing = log_records(spark, log, known)
        bad = [r["receipt_id"] for r in record_conflicts(records, existing).limit(5).collect()]
        if bad:
            raise RecordConflict(f"records exist with other content: {', '.join(bad)}")
        new = records.select("receipt_id", "body").dropDuplicates(["receipt_id"]).join(existing.select("receipt_id"), "receipt_id", "left_anti")
        if new.isEmpty():
            return existing
        batch = uuid.uuid4().hex
        folder = f"{qualified(spark, log).rstrip('/')}/batch={batch}"
        new.withColumn("written_at", F.current_timestamp()).write.json(folder)
        if claim(spark, log, known + 1, {"batch": batch}):
            return log_records(spark, log, known + 1)
        remove_folder(spark, folder)
