"""Source trees into the raw store: judge, write sorted text, count again, record.

All days of a batch go through the same few jobs. Nothing is written for a day that breaks a rule. Rows go to a folder of this
run, are counted there and recorded in the store's index, the manifests of the sound days follow, and one version of the store
publishes them all. A job that dies before that has changed nothing anybody reads, and is simply run again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelake.functions import archive_day, canonical_prefix, rollup_digest
from tapelake.functions.names import day_folder
from tapelake.operators.typed_scan import short_times
from tapelake.operators.ingest_rules import (BLANK, dropped_by_prefix, file_facts, file_problems, in_universe, line_facts,
                                             path_problems, placed_files, quote_only, repeated_days, stream_receipts,
                                             symbol_streams)
from tapelake.schema import MAIN_PREFIXES, ROW_GROUP_ROWS, STREAMS, SYMBOL_COL, TIME_COL
from tapelake.session import qualified, shared_dir, small_frame
from tapelake.sources.csv_tree import SourceError, header_text, tree_files, tree_lines
from tapelake.sources.files import read_footers, remove_folder, with_digests, with_heads
from tapelake.sources.raw_store import index_store, manifest_files, scan_containers, store_files
from tapelake.sources.snapshots import Snapshot, commit, snapshot
from tapelake.sources.store_index import bind_sources, source_changes, with_leaves

#: What one task sorts and writes: as many bytes, or as many rows.
_BYTES_PER_TASK, _ROWS_PER_TASK = 128 << 20, 4 * ROW_GROUP_ROWS
RECEIPT = """
quality string, day date, source string, source_sha256 string, prefixes array<string>,
streams array<struct<stream:string, n_symbols:bigint, n_rows_csv:bigint, n_rows_parquet:bigint, n_short_times:bigint,
                     header:string, parquet_bytes:bigint, parquet_sha256:string, sha256_csv:string>>,
dropped_by_prefix map<string,bigint>, quote_only_symbols array<string>, empty_files array<array<string>>"""
_STREAM = ("stream", "n_symbols", "n_rows_csv", "n_rows_parquet", "n_short_times", "header", "parquet_bytes", "parquet_sha256",
           "sha256_csv")


@dataclass(frozen=True)
class BatchOutcome:
    """(day, source, status, error) per attempted day, (name, reason) per name passed over."""

    outcomes: DataFrame
    skipped: DataFrame

    @property
    def ok(self) -> bool:
        return self.skipped.isEmpty() and self.outcomes.filter("status <> 'ok'").isEmpty()


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The receipts of all finished days."""
    names = [r["path"] for r in manifest_files(spark, root).select("path").collect()]
    if not names:
        return small_frame(spark, [], RECEIPT)
    return spark.read.schema(RECEIPT).option("mode", "FAILFAST").json(names)


def _hashed(files: DataFrame) -> DataFrame:
    """Files with header, body_offset and ``sha256``, which is over the canonical frame of symbol, header and body."""
    placed = placed_files(with_heads(files)).withColumn("header_text", header_text("header"))
    body = F.col("length") - F.col("body_offset")
    prefix = F.concat(canonical_prefix(F.coalesce("symbol", "rel"), F.coalesce("header_text", F.lit(""))),
                      body.cast("string").cast("binary"), F.unhex(F.lit("00")))
    framed = placed.withColumns({"path": F.concat("root", F.lit("/"), "rel"), "prefix": prefix})
    return with_digests(framed, prefix="prefix", skip="body_offset").select(*files.columns, "header", "body_offset", "sha256")


def _digested(spark: SparkSession, trees: dict[dt.date, str], root: str, rehash: bool) -> DataFrame:
    """Placed files with header and digest; only those that changed since an earlier run are opened."""
    listed = _stored(tree_files(spark, trees), "listing")
    return placed_files(with_leaves(listed, root, _hashed, rehash)).withColumn("header_text", header_text("header"))


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows from a written table in the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _output_digests(spark: SparkSession, root: str, days: list[dt.date], at: Snapshot | None = None) -> DataFrame:
    """(day, stream, n_rows_parquet, parquet_bytes, parquet_sha256) of the written files, read again from storage."""
    files = store_files(spark, root, STREAMS, at).filter(F.col("day").isin(days))
    counted = read_footers(files.select("day", "stream", "path", "length")).groupBy("day", "stream", "path", "length") \
        .agg(F.max("file_rows").alias("n"))
    return with_digests(counted).groupBy("day", "stream").agg(
        F.sum("n").alias("n_rows_parquet"), F.sum("length").alias("parquet_bytes"),
        rollup_digest(F.substring_index("path", "/", -1), "sha256").alias("parquet_sha256"))


def _with_short_times(outputs: DataFrame, root: str, days: list[dt.date], run: str) -> DataFrame:
    """Add ``n_short_times``, which spares every later read its own look at the time column."""
    spark = outputs.sparkSession
    base = qualified(spark, root).rstrip("/")
    found = [short_times(scan_containers(spark, [day_folder(f"{base}/{s}", run, d) for d in days], [TIME_COL])).withColumn("stream", F.lit(s))
             for s in STREAMS]
    counts = reduce(DataFrame.unionByName, found).withColumnRenamed("n", "n_short_times")
    return outputs.join(counts, ["day", "stream"], "left").fillna(0, ["n_short_times"])


def _what_changed(files: DataFrame, root: str, base: Snapshot, days: list[dt.date]) -> dict[dt.date, str]:
    """For each of the days, the first source file that changed since it was published, and how many did."""
    changes = source_changes(files, root, {d: base.runs[d] for d in days if d in base.runs})
    first = changes.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rel", "change")).alias("e"))
    return {r["day"]: f": {r['e']['rel']} {r['e']['change']} ({r['n']} in all)" for r in first.collect()}


def _done_days(spark: SparkSession, root: str, sources: DataFrame, prefixes: tuple[str, ...], files: DataFrame,
               base: Snapshot) -> dict[dt.date, str | None]:
    """Days with a manifest: null when source, prefixes and output still agree with it, else what does not."""
    days = [r["day"] for r in sources.select("day").collect()]
    have = manifests(spark, root).filter(F.col("day").isin(days))
    rows = have.join(sources, "day").select("day", "source_sha256", "found", "prefixes", "streams").collect()
    if not rows:
        return {}
    now = {(r["day"], r["stream"]): r["parquet_sha256"] for r in _output_digests(spark, root, [r["day"] for r in rows]).collect()}
    other = [r["day"] for r in rows if r["source_sha256"] != r["found"]]
    changed = _what_changed(files, root, base, other) if other else {}
    out: dict[dt.date, str | None] = {}
    for r in rows:
        altered = [s["stream"] for s in r["streams"] if now.get((r["day"], s["stream"])) != s["parquet_sha256"]]
        if r["source_sha256"] != r["found"]:
            out[r["day"]] = f"already ingested from a source with another sha256{changed.get(r['day'], '')}"
        elif tuple(r["prefixes"]) != prefixes:
            out[r["day"]] = "already ingested with other prefixes"
        elif {s["stream"] for s in r["streams"]} != set(STREAMS):
            continue
        else:
            out[r["day"]] = f"written files differ from the manifest: {', '.join(altered)}" if altered else None
    return out


def _header_lines(lines: DataFrame, ascii_headers: DataFrame, how: str) -> DataFrame:
    """Lines that are (or with an anti join are not) the ASCII header of their own stream and day."""
    return lines.join(ascii_headers, ["day", "stream", "line"], how)


def _data_lines(lines: DataFrame, ascii_headers: DataFrame) -> DataFrame:
    """Lines below the header. A header with GBK characters is the one non-ASCII line its file may have."""
    line = F.col("line")
    keep = (F.octet_length(line) > 0) & F.is_valid_utf8(line) & (F.char_length(line) == F.octet_length(line))
    return _header_lines(lines.filter(keep), ascii_headers, "left_anti")


def _ascii_headers(facts: DataFrame) -> DataFrame:
    """(day, stream, line): the ASCII header of each stream that has just one, so at most three rows a day.

    A blank first line is no header, and must not be sought among the blank lines of other files.
    """
    header = F.col("header").cast("string")
    found = facts.filter("header_ascii and length > 0").filter(~header.rlike(BLANK)).groupBy("day", "stream") \
        .agg(F.min(header).alias("line"), F.max(header).alias("last")).filter("line = last").drop("last")
    rows = found.select("day", "stream", "line").collect()
    return small_frame(facts.sparkSession, [tuple(r) for r in rows], "day date, stream string, line string")


def sorted_rows(lines: DataFrame, width: int, parts: int) -> DataFrame:
    """Data lines as the store's columns in store order: by day and symbol, within a symbol in source order.

    The range partitioning includes the place in the file, so one symbol's lines may spread over several part files.
    """
    order = ["date", SYMBOL_COL, "block", "seq"]
    placed = lines.select(F.date_format("day", "yyyyMMdd").cast("int").alias("date"), F.col("symbol").alias(SYMBOL_COL), "block",
                          "seq", F.split("line", ",").alias("cells"))
    spread = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return spread.select(*[F.get("cells", F.lit(i)).alias(f"column_{i + 1}") for i in range(width)], SYMBOL_COL, "date")


def write_rows(rows: DataFrame, target: str) -> None:
    """Into ``target/date=YYYYMMDD``: zstd, small row groups. A day's earlier files are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd") \
        .option("parquet.block.row.count.limit", ROW_GROUP_ROWS).partitionBy("date").parquet(target)


def _write_streams(lines: DataFrame, facts: DataFrame, root: str, run: str, days: list[dt.date], prefixes: tuple[str, ...],
                   ascii_headers: DataFrame) -> None:
    spark = lines.sparkSession
    shapes = facts.filter(F.col("day").isin(days)).groupBy("stream", "day").agg(
        F.max("header_fields").alias("width"), F.sum("length").alias("bytes"), F.sum("n_rows").alias("n")).collect()
    body = _data_lines(lines, ascii_headers).filter(in_universe(prefixes))
    for stream, width in sorted({(r["stream"], r["width"]) for r in shapes}):
        target = f"{root.rstrip('/')}/{stream}/v={run}"
        group = [r for r in shapes if (r["stream"], r["width"]) == (stream, width)]
        filled = [r["day"] for r in group if r["n"]]
        if filled:
            chosen = body.filter((F.col("stream") == stream) & F.col("day").isin(filled))
            parts = 1 + max(sum(r["bytes"] for r in group) // _BYTES_PER_TASK, sum(r["n"] for r in group) // _ROWS_PER_TASK)
            write_rows(sorted_rows(chosen, width, parts), target)
        for r in group:           # a day of headers only still gets its file
            if not r["n"]:
                names = [f"column_{i + 1}" for i in range(width)] + [SYMBOL_COL]
                nothing = small_frame(spark, [], T.StructType([T.StructField(c, T.StringType()) for c in names]))
                nothing.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/date={r['day']:%Y%m%d}")


def _receipts(files: DataFrame, facts: DataFrame, outputs: DataFrame, sources: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """One receipt per day. The lists are per symbol of a day, so the symbol space bounds them."""
    digests = facts.filter("length > 0").groupBy("day", "stream").agg(rollup_digest("symbol", "sha256").alias("sha256_csv"))
    streams = stream_receipts(facts).withColumn("header", header_text(F.unhex("header_hex"))) \
        .join(outputs, ["day", "stream"]).join(digests, ["day", "stream"])
    by_day = streams.groupBy("day").agg(F.sort_array(F.collect_list(F.struct(*_STREAM))).alias("streams"))
    dropped = dropped_by_prefix(files, prefixes).groupBy("day").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("prefix", "symbols")))).alias("dropped_by_prefix"))
    quiet = quote_only(symbol_streams(files, prefixes)).groupBy("day") \
        .agg(F.sort_array(F.collect_list("symbol")).alias("quote_only_symbols"))
    empty = facts.filter("length = 0").groupBy("day") \
        .agg(F.sort_array(F.collect_list(F.array("symbol", "stream"))).alias("empty_files"))
    whole = by_day.join(sources, "day").join(dropped, "day", "left").join(quiet, "day", "left").join(empty, "day", "left")
    none = F.array().cast("array<string>")
    return whole.select(
        F.lit("self_consistent").alias("quality"), "day", "source", F.col("found").alias("source_sha256"),
        F.array(*[F.lit(p) for p in prefixes]).alias("prefixes"), "streams",
        F.coalesce("dropped_by_prefix", F.create_map().cast("map<string,bigint>")).alias("dropped_by_prefix"),
        F.coalesce("quote_only_symbols", none).alias("quote_only_symbols"),
        F.coalesce("empty_files", F.array().cast("array<array<string>>")).alias("empty_files"))


def _ingest(spark: SparkSession, trees: dict[dt.date, str], root: str, prefixes: tuple[str, ...],
            stop_on_error: bool, rehash: bool) -> list[tuple[dt.date, str, str, str | None]]:
    """Outcome rows in the order of ``trees``."""
    files = _stored(_digested(spark, trees, root, rehash), "files")
    source = small_frame(spark, [(d, t) for d, t in trees.items()], "day date, source string")
    sources = _stored(source.join(files.groupBy("day").agg(rollup_digest("rel", "sha256").alias("found")), "day", "left"), "sources")
    base = snapshot(spark, root)
    errors = _done_days(spark, root, sources, prefixes, files, base)
    done = {d for d, e in errors.items() if e is None}
    errors = {d: e for d, e in errors.items() if e}
    new = {d: t for d, t in trees.items() if d not in done and d not in errors}
    if new:
        lines = tree_lines(spark, new)
        chosen = F.col("day").isin(list(new))
        judged = files.filter(chosen)
        facts = _stored(file_facts(judged, line_facts(lines), prefixes), "facts")
        headers = _ascii_headers(facts)
        place = F.concat_ws(" ", "stream", "symbol").alias("detail")
        # an all-ASCII header is only told from the body by its text, which must then be unique
        again = _header_lines(lines, headers, "left_semi").groupBy("day", "stream", "symbol").count().filter("count > 1")
        problems = path_problems(judged, source.filter(chosen), prefixes).unionByName(file_problems(facts)) \
            .unionByName(facts.filter("length > 0 and header_text is null").select("day", F.lit("header is not GBK").alias("problem"), place)) \
            .unionByName(again.select("day", F.lit("a line repeats the header").alias("problem"), place))
        first = problems.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("problem", "detail")).alias("e"))
        errors |= {r["day"]: f"{r['e']['problem']}: {r['e']['detail']} ({r['n']} in all)" for r in first.collect()}
        wanted = [d for d in _attempted(trees, errors, stop_on_error) if d in new and d not in errors]
        if wanted:
            run = uuid.uuid4().hex
            _write_streams(lines, facts, root, run, wanted, prefixes, headers)
            outputs = _stored(_with_short_times(_output_digests(spark, root, wanted, base.plus(wanted, run)), root, wanted, run), "outputs")
            errors |= _miscounted(facts.filter(F.col("day").isin(wanted)), outputs)
            good = [d for d in _attempted(trees, errors, stop_on_error) if d in wanted and d not in errors]
            for day in set(wanted) - set(good):
                for stream in STREAMS:
                    remove_folder(spark, day_folder(f"{root.rstrip('/')}/{stream}", run, day))
            if good:
                _publish(spark, root, run, base, files, facts, outputs, sources, good, prefixes)
    return [(d, trees[d], "failed" if d in errors else "ok", errors.get(d)) for d in _attempted(trees, errors, stop_on_error)]


def _attempted(trees: dict[dt.date, str], errors: dict[dt.date, str], stop_on_error: bool) -> list[dt.date]:
    """All days, or those up to the first failed one."""
    days = list(trees)
    failed = [i for i, d in enumerate(days) if d in errors]
    return days[:failed[0] + 1] if failed and stop_on_error else days


def _miscounted(facts: DataFrame, outputs: DataFrame) -> dict[dt.date, str]:
    """Days whose written rows are not as many as their lines."""
    counted = stream_receipts(facts).join(outputs, ["day", "stream"], "left") \
        .filter(~F.col("n_rows_csv").eqNullSafe(F.col("n_rows_parquet")))
    rows = counted.sort("day", "stream").select("day", "stream", "n_rows_csv", "n_rows_parquet").collect()
    found: dict[dt.date, list[str]] = {}
    for r in rows:
        found.setdefault(r["day"], []).append(f"{r['stream']}: {r['n_rows_csv']} lines, {r['n_rows_parquet']} rows")
    return {d: "; ".join(texts) for d, texts in found.items()}


def _publish(spark: SparkSession, root: str, run: str, base: Snapshot, files: DataFrame, facts: DataFrame, outputs: DataFrame,
             sources: DataFrame, good: list[dt.date], prefixes: tuple[str, ...]) -> None:
    """Record the good days' files and write their manifests, then publish them all at once."""
    index_store(spark, root, days=good, at=base.plus(good, run))
    chosen: Column = F.col("day").isin(good)
    bind_sources(files.filter(chosen), root, run)
    receipts = _receipts(files.filter(chosen), facts.filter(chosen), outputs, sources.filter(chosen), prefixes)
    receipts.withColumn("date", F.date_format("day", "yyyyMMdd")).repartition("date").write.mode("overwrite") \
        .partitionBy("date").json(f"{root.rstrip('/')}/manifest/v={run}")
    commit(spark, root, good, run, base)


def ingest(spark: SparkSession, day: dt.date, tree: str, root: str, prefixes: tuple[str, ...] = MAIN_PREFIXES,
           rehash: bool = False) -> DataFrame:
    """Ingest one unpacked day; its receipt. A day done before from the same source is left untouched.

    Source files whose place, length and time of change are those of an earlier run are not hashed again unless ``rehash``.
    """
    ((_, _, status, error),) = _ingest(spark, {day: tree}, root, tuple(prefixes), True, rehash)
    if status != "ok":
        raise SourceError(f"{day:%Y-%m-%d}: {error}")
    return manifests(spark, root).filter(F.col("day") == F.lit(day))


def ingest_days(spark: SparkSession, trees: list[str], root: str, prefixes: tuple[str, ...] = MAIN_PREFIXES,
                stop_on_error: bool = True, rehash: bool = False) -> BatchOutcome:
    """Ingest unpacked days, each in a folder named after its archive, ``YYYYMMDD.7z``.

    Other names are skipped and listed. With ``stop_on_error`` no day after the first bad one is published.
    """
    named = small_frame(spark, [(i, t, t.rstrip("/").rsplit("/", 1)[-1]) for i, t in enumerate(trees)],
                                  "pos int, source string, name string").withColumn("day", archive_day("name"))
    twice = repeated_days(named).collect()
    if twice:
        raise ValueError(f"several archives for one day: {', '.join(f'{r['day']:%Y%m%d}' for r in twice)}")
    skipped = named.filter("day is null").select("source", F.lit("name is not YYYYMMDD.7z").alias("reason"))
    chosen = {r["day"]: r["source"] for r in named.filter("day is not null").sort("pos").collect()}
    rows = _ingest(spark, chosen, root, tuple(prefixes), stop_on_error, rehash) if chosen else []
    outcomes = small_frame(spark, rows, "day date, source string, status string, error string")
    return BatchOutcome(outcomes, skipped)
