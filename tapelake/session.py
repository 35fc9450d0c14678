"""Session settings and shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Setting, Spark's default, ours.
_SETTINGS = (
    # The JVM does not compile methods over 8000 bytes; a generated stage above that runs three times slower than the
    # split-up code Spark falls back to when this limit says so.
    ("spark.sql.codegen.hugeMethodLimit", "65535", "8000"),
    # A stage this wide is over that limit anyway; not generating it first halves the fixed cost of a ten-level read.
    ("spark.sql.codegen.maxFields", "100", "40"),
    # Above this many symbols Spark prunes row groups by the smallest and largest symbol only.
    ("spark.sql.parquet.pushdown.inFilterThreshold", "10", "256"),
)


def prepare(spark: SparkSession) -> SparkSession:
    """Fit the session to wide decoding and symbol lists; settings somebody changed stay as they are."""
    for name, default, ours in _SETTINGS:
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)
    return spark


def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Rows the driver holds anyway, as a local relation: its size is known, so Catalyst can judge a broadcast."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(schema)
    cells = [pa.array([row[i] for row in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(cells, schema=fields), schema)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="tapelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: what Spark assumes for a bare path, written out for executors."""
    if ":" in path.split("/", 1)[0]:
        return path
    default = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
    return default.rstrip("/") + "/" + path.lstrip("/") if not default.startswith("file:") else "file:" + path
