"""What the registry says about a day and a stream. Only active entries count."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.schema import STREAMS


def _active(entries: DataFrame) -> DataFrame:
    streams = F.when(F.col("stream").isNull(), F.array(*[F.lit(s) for s in STREAMS])).otherwise(F.array("stream"))
    return entries.filter("status = 'active'").withColumn("stream", F.explode(streams))


def day_scoped(entries: DataFrame) -> DataFrame:
    """Active entries spread over their days and streams: (day, stream, pos, id, code, read_layer_action)."""
    return _active(entries).select(F.explode("days").alias("day"), "stream", "pos", "id", "code", "read_layer_action")


def entries_for(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """All active entries for each (day, stream), structural ones included; ``pos`` gives registry order.

    Both parts are equi-joins, so nothing depends on the registry being small. There are only three streams to join the
    structural entries on, so they are dealt over slices by their id and the few keys repeated for each slice.
    """
    slices = 32
    scoped = day_scoped(entries).withColumn("structural", F.lit(False))
    always = _active(entries).filter(F.size("days") == 0) \
        .select("stream", "pos", "id", "code", "read_layer_action", F.lit(True).alias("structural"),
                F.pmod(F.xxhash64("pos", "id"), F.lit(slices)).alias("slice"))
    spread = keys.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))
    names = ["day", "stream", "pos", "id", "code", "read_layer_action", "structural"]
    return keys.join(scoped, ["day", "stream"]).select(*names).unionByName(
        spread.join(always, ["stream", "slice"]).select(*names))


def patches_for(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Day-scoped patch entries for each (day, stream), repeats kept."""
    return keys.join(day_scoped(entries).filter("read_layer_action = 'patch'"), ["day", "stream"])


def defect_codes(entries: DataFrame) -> DataFrame:
    """(day, stream, defects): day-scoped codes the read layer heeds, without repeats, in registry order."""
    first = day_scoped(entries).filter("read_layer_action <> 'none'") \
        .groupBy("day", "stream", "code").agg(F.min("pos").alias("pos"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "code")))
    return first.groupBy("day", "stream").agg(F.transform(ordered, lambda e: e["code"]).alias("defects"))


def with_defects(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Add ``defects`` to rows with (day, stream); an empty array where nothing is registered."""
    defects = F.coalesce(F.col("defects"), F.array().cast("array<string>"))
    return keys.join(defect_codes(entries), ["day", "stream"], "left").withColumn("defects", defects)


def requested_patches(entries: DataFrame, stream: str, days: tuple[dt.date, ...]) -> dict[str, list[dt.date]]:
    """Patch code to the requested days it is registered for; never more rows than days times codes."""
    wanted: Column = F.col("day").isin(list(days))
    rows = day_scoped(entries).filter(wanted & (F.col("stream") == stream) & (F.col("read_layer_action") == "patch"))
    found: dict[str, list[dt.date]] = {}
    for row in rows.select("code", "day").distinct().collect():
        found.setdefault(row["code"], []).append(row["day"])
    return found
