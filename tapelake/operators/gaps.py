"""What was asked for and is not there, and why."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.operators.registry_lookup import with_defects
from tapelake.session import small_frame
from tapelake.sources.store_index import BUCKET, bucket_of, has_bit, symbol_number

GAP_COLUMNS = ("day", "stream", "reason", "symbol", "defects")


def attribute_gaps(stream: str, days: tuple[dt.date, ...], file_days: set[dt.date], entries: DataFrame,
                   symbols: DataFrame | None = None, present: DataFrame | None = None, bitmaps: DataFrame | None = None) -> DataFrame:
    """Gap rows (day, stream, reason, symbol, defects).

    A day without a file is one ``day_missing`` row. On the other days each of ``symbols`` (column symbol) that
    neither ``present`` (day, symbol) nor ``bitmaps`` (day, bucket, bits) has is a ``symbol_absent`` row. ``file_days`` comes from
    the listing, not from rows: a file may hold none. Only absences are ever produced: per symbol the days it has are subtracted
    from the days asked for, and both sets are bounded by the request. A symbol meets the bitmaps of its bucket, one a day.
    """
    spark = entries.sparkSession
    missing = [(d,) for d in days if d not in file_days]
    gaps = small_frame(spark, missing, "day date").select(
        "day", F.lit("day_missing").alias("reason"), F.lit(None).cast("string").alias("symbol"))
    existing = [d for d in days if d in file_days]
    if symbols is not None and existing:
        asked = F.array(*[F.lit(d) for d in existing])
        none = F.array().cast("array<date>")
        rows = symbols.select("symbol").distinct().withColumn("has", none)
        if present is not None:
            has = present.filter(F.col("day").isin(existing)).groupBy("symbol").agg(F.collect_set("day").alias("seen"))
            rows = rows.join(has, "symbol", "left").select("symbol", F.coalesce("seen", none).alias("has"))
        if bitmaps is not None:
            days_of = bitmaps.filter("bits is not null").groupBy("bucket", "day").agg(F.bitmap_or_agg("bits").alias("bits")) \
                .groupBy("bucket").agg(F.collect_list(F.struct("day", "bits")).alias("maps"))
            number = symbol_number(F.col("symbol"))
            rows = rows.withColumn("bucket", bucket_of(number)).withColumn("place", (number % BUCKET).cast("int")).join(days_of, "bucket", "left")
            held = F.transform(F.filter("maps", lambda m: has_bit(m["bits"], F.col("place"))), lambda m: m["day"])
            rows = rows.select("symbol", F.array_union("has", F.coalesce(held, none)).alias("has"))
        lacking = F.array_except(asked, F.col("has"))
        absent = rows.select(F.explode(lacking).alias("day"), F.lit("symbol_absent").alias("reason"), "symbol")
        gaps = gaps.unionByName(absent)
    return with_defects(gaps.withColumn("stream", F.lit(stream)), entries).select(*GAP_COLUMNS)
