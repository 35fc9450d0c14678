"""The raw store: ``{root}/{stream}/date=YYYYMMDD.parquet`` files, or ``date=YYYYMMDD`` folders of part files.

Folders may stand below the ``v=RUN`` folder of the run that wrote them; a version of the store names the runs (``snapshots``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelake.functions import file_day
from tapelake.functions.names import MANIFEST_FILE
from tapelake.operators.gaps import attribute_gaps
from tapelake.operators.registry_lookup import requested_patches
from tapelake.operators.row_groups import read_stats
from tapelake.operators.typed_scan import check_short_times, keep_symbols, needed_columns, short_times, typed_rows
from tapelake.schema import QUALITIES, STREAMS, SYMBOL_COL, TIME_COL, ReadRequest
from tapelake.session import prepare, qualified, small_frame
from tapelake.sources.files import list_files
from tapelake.sources.registry import HANDLED_PATCHES, Registry
from tapelake.sources.snapshots import Snapshot, snapshot, visible
from tapelake.sources.store_index import KEYS, index_path, presence, record_presence, symbol_bitmaps, unfolded, unrecorded, with_footers

_FILE, _ROW = "__file", "__row"


class StoreError(RuntimeError):
    """The store is absent, incomplete, or holds something of an unregistered shape."""


@dataclass(frozen=True)
class Catalog:
    """Footer facts of a stream's files, and the requested days without a file."""

    stream: str
    footers: DataFrame
    missing_days: tuple[dt.date, ...]


@dataclass(frozen=True)
class ReadResult:
    """Typed rows, gap rows and footers of the files read. All are lazy; ``frame`` has no row order."""

    frame: DataFrame
    gaps: DataFrame
    footers: DataFrame
    request: ReadRequest
    _with_place: Callable[[], DataFrame]

    @cached_property
    def stats(self) -> DataFrame:
        """One row: row groups and bytes in all and read, rows returned."""
        rows = self.frame.agg(F.count(F.lit(1)).alias("rows"))
        return read_stats(self.footers, self.request.symbols).join(rows, F.lit(True))

    def placed(self) -> DataFrame:
        """The rows with ``place``, their position in request day order and file order among all rows of these files.

        Places come from the row counts in the footers and the row numbers the scan knows, so nothing is sorted or shuffled.
        """
        # one row a file, like the listing that names them
        files = self.footers.select("day", "path", "file_rows").distinct().groupBy("day").agg(
            F.array_sort(F.collect_list(F.struct(file_number("path").alias("number"), "path", "file_rows"))).alias("files"))
        of_day = {r["day"]: r["files"] for r in files.collect()}
        offsets, before = [], 0
        for day in self.request.days:
            for number, path, rows in of_day.get(day, ()):
                offsets.append((day, path.rsplit("/", 1)[-1], before))
                before += rows
        table = small_frame(self.frame.sparkSession, offsets, f"day date, {_FILE} string, __before bigint")
        rows = self._with_place().withColumn(_FILE, F.substring_index(_FILE, "/", -1)).join(table, ["day", _FILE])
        return rows.select(*self.frame.columns, (F.col(_ROW) + F.col("__before")).alias("place"))

    def _day_ordinal(self) -> Column:
        return F.array_position(F.array(*[F.lit(d) for d in self.request.days]), F.col("day"))

    def ordered(self) -> DataFrame:
        """The rows in request day order, then file order. A global sort, so only on demand."""
        return self._with_place().sort(self._day_ordinal(), *file_order(_FILE), _ROW).drop(_FILE, _ROW)

    def ordered_gaps(self) -> DataFrame:
        return self.gaps.sort(self._day_ordinal(), "symbol")


def _day_number(number: str) -> Column:
    n = F.col(number)
    return F.make_date(F.call_function("div", n, F.lit(10_000)).cast("int"),
                       F.call_function("div", n % 10_000, F.lit(100)).cast("int"), n % 100)


def store_files(spark: SparkSession, root: str, streams: tuple[str, ...] = STREAMS, at: Snapshot | None = None) -> DataFrame:
    """(stream, day, path, container, rel, length, modified) of every data file; ``day`` is null for an unregistered file shape.

    Hidden, marker and temporary files are no data, nor are those of runs that the snapshot ``at`` (the last one) does not name.
    """
    base = qualified(spark, root).rstrip("/")
    files = list_files(spark, [f"{base}/{s}" for s in streams])
    absent = [r["root"] for r in files.filter("rel is null").select("root").collect()]
    if absent:
        raise StoreError(f"raw store lacks its folder: {', '.join(sorted(absent))}")
    named = files.filter(~F.col("rel").rlike(r"(^|/)[._]") & ~F.col("rel").endswith(".tmp"))
    path = F.concat("root", F.lit("/"), "rel")
    container = F.regexp_extract(path, r"^(.*/date=[0-9]{8}(?:\.parquet)?)(?:/[^/]*)?$", 1)
    files = named.select(F.substring_index("root", "/", -1).alias("stream"), file_day(path).alias("day"), path.alias("path"), container.alias("container"),
                         F.concat_ws("/", F.substring_index("root", "/", -1), "rel").alias("rel"), "length", "modified")
    return visible(files, at or snapshot(spark, root))


def manifest_files(spark: SparkSession, root: str, at: Snapshot | None = None) -> DataFrame:
    """(path, rel, length, day) of the manifests of a snapshot's days."""
    listed = list_files(spark, [f"{qualified(spark, root).rstrip('/')}/manifest"]).filter("rel is not null")
    paths = listed.select(F.concat("root", F.lit("/"), "rel").alias("path"), "rel", "length").filter(F.col("path").rlike(MANIFEST_FILE))
    day = F.try_to_date(F.regexp_extract("path", MANIFEST_FILE, 1), "yyyyMMdd")
    return visible(paths.withColumn("day", day), at or snapshot(spark, root))


def file_order(path: str) -> tuple[Column, Column]:
    """Sort keys that bring part files in the order of their numbers, whatever the numbers' width."""
    return file_number(path), F.col(path)


def file_number(path: str) -> Column:
    """The number of a part file; null for a file of another name."""
    number = F.regexp_extract(path, r"part-(\d+)[^/]*$", 1)
    return F.when(number != "", number.cast("bigint"))


def stored_days(spark: SparkSession, root: str) -> tuple[dt.date, ...]:
    """Days with files in all three streams, ascending; files of other shapes are passed over."""
    days = store_files(spark, root).filter("day is not null").groupBy("day") \
        .agg(F.count_distinct("stream").alias("n")).filter(F.col("n") == len(STREAMS))
    return tuple(r["day"] for r in days.sort("day").select("day").collect())


def checked_containers(spark: SparkSession, root: str, stream: str, days: list[dt.date], columns: list[str], at: Snapshot | None = None,
                       index: str | None = None) -> list[str]:
    """Files or folders of the days that exist; a column that a file lacks, which would read as null, raises."""
    files = store_files(spark, root, (stream,), at).filter(F.col("day").isin(list(days)))
    lacking = F.array_except(F.array(*map(F.lit, columns)).cast("array<string>"), "columns")
    found = with_footers(files.select("path", "container", *KEYS), root, index).groupBy("container").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(lacking)))).alias("lacking"), F.min("path").alias("path")).collect()
    for r in sorted(found, key=lambda r: r["path"]):
        if r["lacking"]:
            raise ValueError(f"{r['path']} lacks columns: {', '.join(r['lacking'])}")
    return sorted(r["container"] for r in found)


def scan(spark: SparkSession, root: str, stream: str, days: list[dt.date], columns: list[str], place: bool = False) -> DataFrame:
    """Physical text columns of the days that exist, with ``day``; with ``place``, also each row's file and row number.

    The schema is given, not inferred: only these columns are read, and files may differ in width but must have them all.
    """
    return scan_containers(spark, checked_containers(spark, root, stream, days, columns), columns, place)


def scan_containers(spark: SparkSession, containers: list[str], columns: list[str], place: bool = False) -> DataFrame:
    """The scan itself. File metadata is only asked for where it is needed: Spark fills all of it in, for every row."""
    fields = [T.StructField(c, T.StringType()) for c in columns]
    places = [F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW)] if place else []
    single = sorted(c for c in containers if c.endswith(".parquet"))
    plain, runs = [], []
    for c in sorted(set(containers) - set(single)):
        (runs if "/v=" in c else plain).append(c)
    parts = []
    for folders, depth in ((plain, 1), (runs, 2)):
        if not folders:           # the day is a partition column: constant per file, free to read
            continue
        base = folders[0].rsplit("/", depth)[0]
        reader = spark.read.schema(T.StructType([*fields, T.StructField("date", T.IntegerType())]))
        rows = reader.option("basePath", base).parquet(*folders)
        parts.append(rows.select(_day_number("date").alias("day"), *columns, *places))
    if single:                    # the day is in the file name
        rows = spark.read.schema(T.StructType(fields)).parquet(*single)
        number = F.substring(F.col("_metadata.file_name"), 6, 8).cast("int")
        rows = rows.select(number.alias("__number"), *columns, *places)
        parts.append(rows.select(_day_number("__number").alias("day"), *columns, *([_FILE, _ROW] if place else [])))
    if not parts:
        ends = [T.StructField(_FILE, T.StringType()), T.StructField(_ROW, T.LongType())] if place else []
        parts.append(small_frame(spark, [], T.StructType([T.StructField("day", T.DateType()), *fields, *ends])))
    return reduce(DataFrame.unionByName, parts)


def index_store(spark: SparkSession, root: str, streams: tuple[str, ...] = STREAMS, index: str | None = None,
                days: list[dt.date] | None = None, at: Snapshot | None = None) -> None:
    """Record the footers and symbols of files (of some days) that are not recorded yet: opens and scans no other file."""
    files = store_files(spark, root, streams, at).filter(F.col("day").isNotNull() if days is None else F.col("day").isin(days))
    with_footers(files, root, index)
    for stream in streams:
        own = unrecorded(files.filter(F.col("stream") == stream), root, index)
        containers = [r["container"] for r in own.select("container").distinct().collect()]
        if containers:
            maps = symbol_bitmaps(scan_containers(spark, containers, [SYMBOL_COL], place=True), _FILE)
            rel = F.regexp_extract(_FILE, f".*/({stream}/(?:v=[^/]+/)?date=.*)$", 1).alias("rel")
            record_presence(own, maps.select(rel, "bucket", "bits"), root, index)


class RawStore:
    """Reads over one store. Building it checks that the root and its three stream folders exist."""

    def __init__(self, spark: SparkSession, root: str, registry: Registry, index: str | None = None, version: int | None = None) -> None:
        """All reads see one version of the store, the last one by now unless another is asked for.

        ``index`` is where facts of the files are kept, if not beside them: a folder a reader may write to.
        """
        self.spark = prepare(spark)
        self.at = snapshot(spark, root, version)
        self.root = root
        self.registry = registry
        self.index = index or index_path(spark, root)
        store_files(spark, root, STREAMS, self.at)

    def _containers(self, streams: tuple[str, ...] = STREAMS) -> dict[str, dict[dt.date, list[str]]]:
        """Stream to day to the day's file or folder, from one listing; a file of an unregistered shape raises."""
        listed = store_files(self.spark, self.root, streams, self.at).groupBy("stream", "day", "container") \
            .agg(F.min("path").alias("path")).collect()
        bad = sorted(r["path"] for r in listed if r["day"] is None)
        if bad:
            raise StoreError(f"files of an unregistered shape: {', '.join(bad[:5])}")
        found: dict[str, dict[dt.date, list[str]]] = {s: {} for s in streams}
        for r in listed:
            found[r["stream"]].setdefault(r["day"], []).append(r["container"])
        return found

    def _footers(self, stream: str, days: tuple[dt.date, ...], columns: list[str]) -> DataFrame:
        """Footers of the days' files, judged: a missing column or a row group without symbol range raises."""
        files = store_files(self.spark, self.root, (stream,), self.at).filter(F.col("day").isin(list(days)))
        footers = unfolded(with_footers(files.select("stream", "day", "path", *KEYS), self.root, self.index))
        lacking = F.array_except(F.array(*[F.lit(c) for c in columns]), F.col("columns"))
        bad = footers.select("path", "row_group", "has_range", F.array_join(lacking, ", ").alias("lacking")) \
            .filter("not has_range or lacking <> ''").limit(5).collect()
        for r in bad:
            what = f"lacks {r['lacking']}" if r["lacking"] else f"has no symbol statistics in non-empty row group {r['row_group']}"
            raise StoreError(f"{r['path']} {what}")
        return footers.drop("has_range")

    def build_index(self, streams: tuple[str, ...] = STREAMS) -> None:
        """Record the footers and symbols of all files that are not recorded yet, as ingestion does for its own."""
        index_store(self.spark, self.root, streams, self.index, at=self.at)

    def manifests(self) -> DataFrame:
        """(day, path, text) of every manifest."""
        day = F.try_to_date(F.regexp_extract("path", MANIFEST_FILE, 1), "yyyyMMdd")
        paths = manifest_files(self.spark, self.root, self.at).select("path", "length", "day")
        # Spark's readers pass over empty files, so the text joins the listing and not the other way round
        names = [r["path"] for r in paths.filter("length > 0").select("path").collect()]
        if not names:
            return paths.select("day", "path", F.lit(None).cast("string").alias("text"))
        text = self.spark.read.text(names, wholetext=True) \
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")) \
            .select(day.alias("day"), "text")
        return paths.select("day", "path").join(text, "day", "left")

    def day_quality(self) -> DataFrame:
        """(day, quality) for days complete in all streams; no manifest means ``unverified``, a bad one raises."""
        days = small_frame(self.spark, [(d,) for d in self.days()], "day date")
        value = F.try_parse_json("text")
        stated = self.manifests().select("day", "path", F.try_variant_get(value, "$.quality", "string").alias("quality"))
        bad = stated.filter(~F.coalesce(F.col("quality").isin(*QUALITIES), F.lit(False))).limit(5).collect()
        if bad:
            raise StoreError("; ".join(f"bad manifest {r['path']}: quality {r['quality']!r}" for r in bad))
        return days.join(stated.select("day", "quality"), "day", "left") \
            .withColumn("quality", F.coalesce("quality", F.lit("unverified")))

    def days(self, quality: str | None = None) -> tuple[dt.date, ...]:
        """Days with files in all three streams, ascending, optionally of one quality."""
        if quality is None:
            return tuple(sorted(set.intersection(*(set(days) for days in self._containers().values()))))
        if quality not in QUALITIES:
            raise ValueError(f"unknown quality {quality!r}")
        rows = self.day_quality().filter(F.col("quality") == quality).sort("day")
        return tuple(r["day"] for r in rows.collect())

    def quality(self, day: dt.date) -> str:
        """Stated quality of a day; ``unverified`` when nothing is stated."""
        value = F.try_variant_get(F.try_parse_json("text"), "$.quality", "string")
        rows = self.manifests().filter(F.col("day") == F.lit(day)).select("path", value.alias("quality")).collect()
        for r in rows:
            if r["quality"] not in QUALITIES:
                raise StoreError(f"bad manifest {r['path']}: quality {r['quality']!r}")
        return rows[0]["quality"] if rows else "unverified"

    def catalog(self, stream: str, days: tuple[dt.date, ...]) -> Catalog:
        """Footers of the requested days; a non-empty row group without a symbol range raises."""
        have = self._containers((stream,))[stream]
        return Catalog(stream, self._footers(stream, days, [SYMBOL_COL]), tuple(d for d in days if d not in have))

    def read(self, request: ReadRequest) -> ReadResult:
        """Typed rows of the request. Unregistered short times and patches without handler raise here, before any row."""
        columns = needed_columns(request)
        patches = requested_patches(self.registry.entries, request.stream, request.days)
        listed = self._containers((request.stream,))[request.stream]
        found = {d: listed[d] for d in request.days if d in listed}
        file_days = set(found)
        unknown = sorted(c for c, days in patches.items() if c not in HANDLED_PATCHES and file_days & set(days))
        if unknown:
            raise StoreError(f"patches without handler for {request.stream}: {', '.join(unknown)}")
        containers = [c for day in found.values() for c in day]
        # a column absent from a file would otherwise read as null
        footers = self._footers(request.stream, request.days, columns)
        raw = scan_containers(self.spark, containers, columns)
        patched = sorted(patches.get("time_6digit", []))
        if TIME_COL in columns:
            check_short_times(self._short_times(request.stream, {d: c for d, c in found.items() if d not in patched}), request)

        def with_place() -> DataFrame:
            placed = scan_containers(self.spark, containers, columns, place=True)
            return typed_rows(placed, request, patched, keep=(_FILE, _ROW))

        symbols = present = bitmaps = None
        if request.symbols is not None:
            symbols = small_frame(self.spark, [(s,) for s in sorted(request.symbols)], "symbol string")
            files = store_files(self.spark, self.root, (request.stream,), self.at).filter(F.col("day").isin(list(request.days)))
            open_days = unrecorded(files, self.root, self.index).select("day").distinct()
            rest = [c for r in open_days.collect() for c in found[r["day"]]]
            bitmaps = presence(files.select("day", *KEYS), self.root, self.index)
            if rest:  # one aggregation over the symbol column alone; the symbol filter prunes row groups here too
                present = keep_symbols(scan_containers(self.spark, rest, [SYMBOL_COL]), request.symbols) \
                    .select("day", F.col(SYMBOL_COL).alias("symbol")).distinct()
        gaps = attribute_gaps(request.stream, request.days, file_days, self.registry.entries, symbols, present, bitmaps)
        return ReadResult(typed_rows(raw, request, patched), gaps, footers, request, with_place)

    def _short_times(self, stream: str, found: dict[dt.date, list[str]]) -> DataFrame:
        """(day, n) over whole days: as their manifests state it, else counted from the time column."""
        value = F.try_variant_get(F.try_parse_json("text"), "$.streams", "array<struct<stream:string,n_short_times:bigint>>")
        of_stream = F.filter("streams", lambda s: (s["stream"] == stream) & s["n_short_times"].isNotNull())
        stated = self.manifests().filter(F.col("day").isin(list(found))).select("day", value.alias("streams")) \
            .select("day", F.get(of_stream, F.lit(0))["n_short_times"].alias("n")).filter("n is not null")
        known = {r["day"]: r["n"] for r in stated.collect()}
        rest = [c for d, containers in found.items() if d not in known for c in containers]
        counts = small_frame(self.spark, list(known.items()), "day date, n bigint")
        return counts.unionByName(short_times(scan_containers(self.spark, rest, [TIME_COL]))) if rest else counts

    def inspect_days(self, stream: str, days: tuple[dt.date, ...], columns: tuple[str, ...], symbols: frozenset[str] | None = None) -> DataFrame:
        """``day`` and named physical columns as text, untouched by fields, registry or decoding.

        A day without a file and a column that a file lacks raise before any row is read.
        """
        have = self._containers((stream,))[stream]
        absent = [d for d in days if d not in have]
        if absent:
            raise FileNotFoundError(f"no file of {stream} for {', '.join(f'{d:%Y-%m-%d}' for d in absent)}")
        wanted = list(dict.fromkeys([*columns, SYMBOL_COL]))
        containers = checked_containers(self.spark, self.root, stream, list(days), wanted, self.at, self.index)
        return keep_symbols(scan_containers(self.spark, containers, wanted), symbols).select("day", *columns)

    def inspect_raw(self, stream: str, day: dt.date, columns: tuple[str, ...], symbols: frozenset[str] | None = None) -> DataFrame:
        """The same of one day, without ``day``."""
        return self.inspect_days(stream, (day,), columns, symbols).select(*columns)
