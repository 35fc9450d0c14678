"""Tables written to the shared folder between the steps of an operator, and names that clash with none of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.session import shared_dir

_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def stored(df: DataFrame, purpose: str, keep: bool = False) -> DataFrame:
    """The rows as a Parquet table in the folder all executors share: cuts the lineage, survives lost executors.

    Within ``scratch`` its path is noted there, unless the table is to be kept.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    tables = _TABLES.get()
    if tables is not None and not keep:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(tables: list[str]) -> Iterator[list[str]]:
    """Note the tables that operators store meanwhile. Whoever has written or collected their results may ``release`` them."""
    token = _TABLES.set(tables)
    try:
        yield tables
    finally:
        _TABLES.reset(token)


def release(spark: SparkSession, tables: list[str]) -> None:
    """Remove the noted tables; results that were not written or collected by now can no longer be."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(hadoop).delete(path, True)


def numbered(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The columns under names of their own, together with the ``used`` ones as they are, and what restores the first.

    An operator may add any column to the first frame whose name does not begin with ``_column``: no name can clash.
    """
    own = [f"_column{i}" for i in range(len(df.columns))]
    inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, own)], *[F.col(f"`{c}`").alias(c) for c in used])
    return inner, lambda out: out.select(*[F.col(n).alias(c) for c, n in zip(df.columns, own)])


def renamed_apart(df: DataFrame, added: Sequence[str]) -> DataFrame:
    """The frame with ``input_`` before the names of columns that would clash with the added ones, as often as it takes."""
    taken = {c.lower() for c in df.columns}
    out = df
    for c in df.columns:
        if c.lower() in {a.lower() for a in added}:
            name = f"input_{c}"
            while name.lower() in taken:
                name = f"input_{name}"
            taken.add(name.lower())
            out = out.withColumnRenamed(c, name)
    return out
