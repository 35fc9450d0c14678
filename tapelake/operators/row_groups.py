"""Reports over parquet footers: which row groups a read touches, and how many bytes that is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def selected_row_groups(footers: DataFrame, symbols: frozenset[str] | None = None) -> DataFrame:
    """Footer rows whose closed symbol range meets a requested symbol; all of them when none are requested.

    A range meets the request when the first requested symbol not below its minimum is not above its maximum: one
    binary search per footer row in the sorted request, which the symbol pattern keeps bounded.
    """
    groups = footers.filter("row_group is not null")
    if symbols is None:
        return groups
    wanted = np.array(sorted(symbols), dtype=object)

    @F.pandas_udf("boolean")
    def meets(low: pd.Series, high: pd.Series) -> pd.Series:
        at = np.searchsorted(wanted, low.to_numpy(dtype=object))
        first = wanted[np.minimum(at, len(wanted) - 1)]
        return pd.Series((at < len(wanted)) & (first <= high.to_numpy(dtype=object)))

    return groups.filter(F.col("rows") > 0).filter(meets("symbol_min", "symbol_max"))


def read_stats(footers: DataFrame, symbols: frozenset[str] | None = None) -> DataFrame:
    """One row: row groups and bytes in all, and those a read of these symbols touches. Bytes count all columns."""
    groups = footers.filter("row_group is not null")
    totals = groups.agg(F.count(F.lit(1)).alias("row_groups_total"),
                        F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes_total"))
    read = selected_row_groups(footers, symbols).agg(F.count(F.lit(1)).alias("row_groups_read"),
                                                     F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes_read"))
    return totals.join(read, F.lit(True))


def file_facts(footers: DataFrame) -> DataFrame:
    """Per stream and day: files, rows, row groups, bytes, symbol range."""
    per_file = footers.groupBy("stream", "day", "path").agg(
        F.max("file_rows").alias("rows"), F.count("row_group").alias("row_groups"),
        F.sum("byte_size").alias("bytes"), F.min(F.when(F.col("rows") > 0, F.col("symbol_min"))).alias("low"),
        F.max(F.when(F.col("rows") > 0, F.col("symbol_max"))).alias("high"))
    return per_file.groupBy("stream", "day").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("row_groups").alias("row_groups"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("low").alias("symbol_min"),
        F.max("high").alias("symbol_max"))
