"""The registered queries: each runs an operator over whole tables, or over raw text Spark derives from them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.functions import archive_day, canonical_frame, to_int64
from tapelake.operators import audit, registry_lookup, registry_rules
from tapelake.operators.content_digest import content_digests
from tapelake.operators.ingest import ingest_days, manifests, sorted_rows, write_rows
from tapelake.operators.ingest_rules import (dropped_by_prefix, file_facts, file_problems, line_facts, path_problems,
                                             placed_files, quote_only, repeated_days, stream_receipts, symbol_streams)
from tapelake.operators.row_groups import file_facts as footer_facts
from tapelake.operators.shape_stream import stream_time_shapes, streamed_shapes
from tapelake.operators.typed_scan import short_times, typed_rows
from tapelake.plans.encode import (alter_trees, chained_registry, earlier_registry, event_store, faulty_registry, later_registry, odd_time_text, part_registry,
                                   pick, raw_rows, source_files, source_lines, source_trees, symbol_of, table)
from tapelake.schema import CONTINUOUS_EXCL_AUCTIONS, FIELDS, MAIN_PREFIXES, STREAMS, SYMBOL_COL, ReadRequest
from tapelake.session import prepare, qualified, shared_dir
from tapelake.sources.files import bound_file_problems, list_files, read_footers, with_digests, write_lines
from tapelake.sources.raw_store import RawStore, store_files
from tapelake.sources.registry import HANDLED_PATCHES, parse_registry, typed_entries
from tapelake.sources.run_log import append_records, record_conflicts, run_records
from tapelake.sources.store_index import KEYS, unfolded, with_footers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_ENTRY = """[[defect]]
id = "{id}"
code = "{code}"
kind = "defect"
status = "active"
created_at = 2024-01-01
evidence = "docs/{id}.md"
evidence_sha256 = "{digest}"
read_layer_action = "{action}"
{scope}
"""
_DIGEST = "0" * 64
STORE_REGISTRY = "".join(_ENTRY.format(id=i, code=c, action=a, scope=s, digest=_DIGEST) for i, c, a, s in (
    ("D1", "rescue_partial", "gap", "days = [2024-01-05, 2024-02-06]"),
    ("D2", "seq_empty", "gap", 'days = [2024-01-05, 2024-01-07]\nstream = "orders"'),
    ("D3", "seq_sparse_dup", "gap", 'days = [2024-01-05]\nstream = "trades"'),
    ("D4", "enum_drift", "none", "")))
EXTRA_DAYS = (dt.date(2024, 2, 6), dt.date(2024, 2, 7))


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(prepare(spark), sf_dir)

    QUERIES[f.__name__] = run
    return f


def _text_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


def _store(spark: SparkSession, sf_dir: str) -> RawStore:
    return RawStore(spark, event_store(spark, sf_dir), parse_registry(spark, STORE_REGISTRY))


def _symbols(spark: SparkSession, sf_dir: str, name: str, key: str) -> frozenset[str]:
    """Symbols of a key column; the symbol space bounds them however large the table is."""
    rows = table(spark, sf_dir, name).select(symbol_of(key).alias("s")).distinct()
    return frozenset(r["s"] for r in rows.collect())


_ORDER_FIELDS = ("time_ms", "oid", "type", "side", "price", "vol")


def _typed(rows: DataFrame) -> DataFrame:
    return _text_day(rows).withColumn("side", F.hex("side"))


def _request(spark: SparkSession, sf_dir: str, stream: str, fields: tuple[str, ...], **kw) -> tuple[RawStore, ReadRequest]:
    store = _store(spark, sf_dir)
    return store, ReadRequest(stream, store.days(), fields, **kw)


# ---------------------------------------------------------------- reads


@query
def typed_scan(spark, sf_dir):
    """All orders, every field decoded."""
    raw = raw_rows(spark, sf_dir).filter("stream = 'orders'")
    return _typed(typed_rows(raw, ReadRequest("orders", (dt.date(2024, 1, 1),), _ORDER_FIELDS), []))


@query
def typed_scan_session(spark, sf_dir):
    """Orders inside the continuous sessions; the time is decoded for the filter alone."""
    raw = raw_rows(spark, sf_dir).filter("stream = 'orders'")
    fields = ("oid", "type", "side", "price", "vol")
    return _typed(typed_rows(raw, ReadRequest("orders", (dt.date(2024, 1, 1),), fields, windows=CONTINUOUS_EXCL_AUCTIONS), []))


@query
def store_read_session(spark, sf_dir):
    """Trades inside the continuous sessions, read from a written store."""
    store, request = _request(spark, sf_dir, "trades", ("time_ms", "seq", "price", "vol", "ask_ref", "bid_ref"),
                              windows=CONTINUOUS_EXCL_AUCTIONS)
    return _text_day(store.read(request).frame)


@query
def store_read_symbols(spark, sf_dir):
    """Orders of the symbols that suppliers stand for: the symbol filter prunes row groups."""
    store, request = _request(spark, sf_dir, "orders", ("time_ms", "oid", "vol", "oid", "day", "symbol"),
                              symbols=_symbols(spark, sf_dir, "supplier", "s_suppkey"))
    return _text_day(store.read(request).frame)


@query
def store_read_long_list(spark, sf_dir):
    """Orders of fifty thousand requested symbols, two of every forty numbers: a few ranges are pushed down, a semi join does the rest."""
    wanted = frozenset(f"{n + odd:06d}.{market}" for n in range(0, 1_000_000, 40) for odd, market in ((0, "SZ"), (1, "SH")))
    store, request = _request(spark, sf_dir, "orders", ("oid", "vol"), symbols=wanted)
    return _text_day(store.read(request).frame)


@query
def store_quotes(spark, sf_dir):
    """Quotes with all ten levels of both sides."""
    store, request = _request(spark, sf_dir, "xinqing", tuple(f.name for f in FIELDS["xinqing"]))
    return _text_day(store.read(request).frame)


@query
def store_gaps(spark, sf_dir):
    """What is missing of all users' symbols on all days, with two days beyond the data."""
    store = _store(spark, sf_dir)
    request = ReadRequest("orders", (*store.days(), *EXTRA_DAYS), ("oid",), symbols=_symbols(spark, sf_dir, "events", "user_id"))
    gaps = store.read(request).gaps
    return _text_day(gaps).withColumn("defects", F.array_join("defects", ","))


@query
def store_order(spark, sf_dir):
    """Each row's place in its day's file: by symbol, and in source order within a symbol."""
    root = event_store(spark, sf_dir)
    rows = audit.positions(spark, root, "orders", list(_store(spark, sf_dir).days()), [SYMBOL_COL, "column_6"])
    return _text_day(rows).select("day", F.col("pos").alias("place"), F.col(SYMBOL_COL).alias("symbol"),
                                  to_int64("column_6").alias("event_id"))


@query
def store_ordered_read(spark, sf_dir):
    """An ordered read over days in descending request order."""
    store = _store(spark, sf_dir)
    days = tuple(reversed(store.days()))
    return _text_day(store.read(ReadRequest("xinqing", days, ("last_price",))).ordered())


@query
def store_placed_read(spark, sf_dir):
    """A read over days in descending request order in which every row states its place, without a sort."""
    store = _store(spark, sf_dir)
    days = tuple(reversed(store.days()))
    return _text_day(store.read(ReadRequest("orders", days, ("oid", "vol"))).placed())


@query
def store_physical_text(spark, sf_dir):
    """Untouched text: lengths and NULs of the price column, day by day."""
    store = _store(spark, sf_dir)
    rows = store.inspect_days("orders", store.days(), ("column_9",))
    return _text_day(rows.groupBy("day", F.octet_length("column_9").alias("len"), (F.col("column_9") == "\x00").alias("is_nul"))
                     .agg(F.count(F.lit(1)).alias("n")))


@query
def store_compare(spark, sf_dir):
    """The store against a copy with altered, emptied and lost cells and rows, stream by stream and day by day."""
    report = audit.compare_stores(spark, event_store(spark, sf_dir), event_store(spark, sf_dir, altered=True), _store(spark, sf_dir).days())
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda s, n: s + n).alias(m)
    return _text_day(report).select("stream", "day", "rows_a", "rows_b", "schema_equal", total("nulls_a"), total("nulls_b"),
                                    total("cells_differ"), "identical_modulo_null")


@query
def store_days(spark, sf_dir):
    """Days complete in all three streams, with their quality."""
    return _text_day(_store(spark, sf_dir).day_quality())


@query
def footer_catalog(spark, sf_dir):
    """Rows and symbol range per stream and day, from the store's table of footers."""
    root = event_store(spark, sf_dir)
    files = store_files(spark, root).select("stream", "day", "path", *KEYS)
    facts = footer_facts(unfolded(with_footers(files, root)))
    return _text_day(facts.select("stream", "day", "rows", "symbol_min", "symbol_max"))


# ---------------------------------------------------------------- decoding


@query
def decode_int_shapes(spark, sf_dir):
    """Line item prices as text in fourteen shapes, decoded; per shape how many have a value, and a checksum."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    shape = (F.col("l_orderkey") + F.col("l_linenumber") + F.col("l_suppkey")) % 14
    shapes = [cents, F.concat(F.lit("　"), cents, F.lit(" \t")), F.concat(cents, F.lit(".0")), F.concat(cents, F.lit("e0")),
              F.concat(F.lit("+"), cents), F.concat(F.lit("-"), cents), F.concat(cents, F.lit("d")), F.concat(F.lit("00"), cents),
              F.lit(""), F.concat(F.lit("\x00"), cents), F.concat(cents, F.lit("000000001")), F.concat(cents, F.lit(".9")),
              F.concat(cents, F.lit("E+1")), F.concat(cents, F.lit("99999999999999"))]
    text = reduce(lambda acc, i: acc.when(shape == i, shapes[i]), range(1, len(shapes)), F.when(shape == 0, shapes[0]))
    rows = table(spark, sf_dir, "lineitem").select(shape.cast("int").alias("shape"), text.alias("t"))
    return rows.select("shape", to_int64("t").alias("v")).groupBy("shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_value"), F.sum(F.col("v") % 1_000_003).alias("checksum"))


def _odd_rows(spark, sf_dir):
    return raw_rows(spark, sf_dir, odd_time_text())


def _days_of(raw: DataFrame) -> tuple[dt.date, ...]:
    return tuple(r["day"] for r in raw.select("day").distinct().collect())


def _patched(spark, sf_dir, raw) -> dict[str, list[dt.date]]:
    entries = typed_entries(part_registry(spark, sf_dir))
    days = _days_of(raw)
    return {s: registry_lookup.requested_patches(entries, s, days).get("time_6digit", []) for s in STREAMS}


@query
def decode_time_lengths(spark, sf_dir):
    """Times of six shapes; the short ones count only on days registered for their stream."""
    raw = _odd_rows(spark, sf_dir)
    patched = _patched(spark, sf_dir, raw)
    request = {s: ReadRequest(s, (dt.date(2024, 1, 1),), ("time_ms",)) for s in STREAMS}
    parts = [typed_rows(raw.filter(F.col("stream") == s), request[s], patched[s], keep=("pos",)) for s in STREAMS]
    return _text_day(reduce(DataFrame.unionByName, parts)).withColumnRenamed("pos", "event_id")


@query
def short_time_days(spark, sf_dir):
    """Days and streams with short times that no entry registers."""
    raw = _odd_rows(spark, sf_dir)
    patched = _patched(spark, sf_dir, raw)
    parts = [short_times(raw.filter(F.col("stream") == s), F.col("day").isin(patched[s])).withColumn("stream", F.lit(s)) for s in STREAMS]
    return _text_day(reduce(DataFrame.unionByName, parts))


# ---------------------------------------------------------------- audits


@query
def time_shape_histogram(spark, sf_dir):
    return _text_day(audit.time_shapes(_odd_rows(spark, sf_dir)))


@query
def time_shapes_resumed(spark, sf_dir):
    """The histogram appended to a table in two runs over the store, the second of which has nothing left to do."""
    root, out = event_store(spark, sf_dir), shared_dir(spark, "shapes")
    audit.append_time_shapes(spark, root, out)
    return audit.append_time_shapes(spark, root, out)


@query
def time_shapes_streamed(spark, sf_dir):
    """The histogram of published days, kept by a stream that ends and starts again between two batches of ingestion."""
    trees, root = source_trees(spark, sf_dir), shared_dir(spark, "streamed")
    out, checkpoint = shared_dir(spark, "streamed-shapes"), shared_dir(spark, "streamed-marks")
    for part in (trees[::2], trees[1::2]):
        ingest_days(spark, part, root, stop_on_error=False)
        stream_time_shapes(spark, root, out, checkpoint)
    return _text_day(streamed_shapes(spark, root, out))


@query
def pending_shapes(spark, sf_dir):
    """(day, stream) pairs not yet recorded, where those with a costly purchase or signup count as recorded."""
    raw = raw_rows(spark, sf_dir).select("day", "stream", to_int64("column_9").alias("price"))
    return _text_day(audit.pending(raw.select("day", "stream").distinct(), raw.filter("price > 2500000")))


@query
def symbol_stream_differences(spark, sf_dir):
    return _text_day(audit.symbol_differences(raw_rows(spark, sf_dir)))


@query
def symbols_only_in_stream(spark, sf_dir):
    only = audit.symbols_only_in(audit.symbol_differences(raw_rows(spark, sf_dir)))
    return _text_day(only).withColumn("symbols", F.array_join("symbols", ","))


@query
def copy_compare(spark, sf_dir):
    """Two copies of all raw rows, one of them altered here and there, compared cell by cell."""
    a = raw_rows(spark, sf_dir)
    p = F.col("pos")
    b = a.withColumns({"column_9": F.when(p % 97 == 0, "changed").otherwise(F.col("column_9")),
                       "column_8": F.when(p % 89 == 1, F.lit(None)).otherwise(F.col("column_8")),
                       "column_10": F.when(p % 83 == 2, F.lit(None)).otherwise(F.col("column_10")),
                       "column_13": F.when(p % 2 == 0, F.lit(None)).otherwise(F.col("column_13"))})
    names = [c for c in a.columns if c not in ("day", "stream", "pos")]
    report = audit.compare_rows(a, b, ["day", "stream"], names)
    touched = F.array_union(F.map_keys("nulls_b"), F.map_keys("cells_differ"))
    rows = report.select("day", "stream", "nulls_b", "cells_differ", F.explode(touched).alias("column"))
    return _text_day(rows).select("day", "stream", "column", F.coalesce(F.try_element_at("nulls_b", "column"), F.lit(0)).alias("nulls_b"),
                                  F.coalesce(F.try_element_at("cells_differ", "column"), F.lit(0)).alias("cells_differ"))


# ---------------------------------------------------------------- registry


def _event_keys(spark, sf_dir):
    return raw_rows(spark, sf_dir).select("day", "stream").distinct()


@query
def registry_entries_for_day(spark, sf_dir):
    found = registry_lookup.entries_for(_event_keys(spark, sf_dir), typed_entries(part_registry(spark, sf_dir)))
    return _text_day(found.select("day", "stream", "id", "code", "structural"))


@query
def registry_patches_for_day(spark, sf_dir):
    found = registry_lookup.patches_for(_event_keys(spark, sf_dir), typed_entries(part_registry(spark, sf_dir)))
    return _text_day(found.select("day", "stream", "id", "code"))


@query
def registry_defect_codes(spark, sf_dir):
    found = registry_lookup.with_defects(_event_keys(spark, sf_dir), typed_entries(part_registry(spark, sf_dir)))
    return _text_day(found).select("day", "stream", F.array_join("defects", ",").alias("defects"))


@query
def registry_rule_problems(spark, sf_dir):
    return registry_rules.rule_problems(faulty_registry(spark, sf_dir), handled=HANDLED_PATCHES)


@query
def registry_chain_problems(spark, sf_dir):
    return registry_rules.chain_problems(chained_registry(spark, sf_dir))


@query
def registry_snapshot_problems(spark, sf_dir):
    return registry_rules.snapshot_problems(earlier_registry(spark, sf_dir), later_registry(spark, sf_dir))


def _observed(spark, sf_dir):
    n = F.col("l_partkey") % 17
    code = F.when(n < 13, pick(registry_rules.DEFECT_CODES, F.least(n, F.lit(12)))).otherwise(F.concat(F.lit("odd_"), n))
    return table(spark, sf_dir, "lineitem").select(code.alias("code"))


@query
def observed_unregistered(spark, sf_dir):
    found = registry_rules.unregistered_codes(_observed(spark, sf_dir), part_registry(spark, sf_dir))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query
def code_sets_differ(spark, sf_dir):
    declared = _observed(spark, sf_dir).filter("code <> 'seq_empty'")
    return registry_rules.code_set_difference(declared, part_registry(spark, sf_dir))


@query
def observation_batches(spark, sf_dir):
    """Batches that list documents as observation files, some of them altered, missing, unlisted or badly named."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    name = F.concat(F.when(k % 31 == 1, "../").otherwise(""), F.lit("doc_"), k, F.lit(".toml"))
    batches = d.filter(k % 29 != 2).select(
        name.alias("file"), F.sha2("text", 256).alias("sha256"),
        F.when(k % 23 == 3, "scripts/scan").when(k % 19 == 4, "external:probe").otherwise("tools/scan").alias("scanner"),
        F.when(k % 2 == 0, "0" * 64).otherwise(F.sha2("source", 256)).alias("scanner_sha256"), F.col("source").alias("input"),
        F.when(k % 17 == 5, F.lit(None)).otherwise(F.sha2("lang", 256)).alias("input_sha256"), F.lit("2024-01-01").alias("scanned_at"))
    code = pick((*registry_rules.DEFECT_CODES, "odd"), k % 14)
    files = d.filter(k % 13 != 6).select(name.alias("file"), F.sha2(F.when(k % 11 == 7, "altered").otherwise(F.col("text")), 256)
                                         .alias("sha256"), F.array(code).alias("codes"))
    return registry_rules.batch_problems(batches, files, part_registry(spark, sf_dir))


# ---------------------------------------------------------------- ingestion


def _facts(spark, sf_dir):
    return file_facts(placed_files(source_files(spark, sf_dir)), line_facts(source_lines(spark, sf_dir)))


@query
def ingest_receipts(spark, sf_dir):
    return _text_day(stream_receipts(_facts(spark, sf_dir)))


@query
def ingest_quote_only(spark, sf_dir):
    return _text_day(quote_only(symbol_streams(placed_files(source_files(spark, sf_dir)))))


@query
def ingest_dropped(spark, sf_dir):
    return _text_day(dropped_by_prefix(placed_files(source_files(spark, sf_dir))))


@query
def ingest_path_problems(spark, sf_dir):
    files = placed_files(source_files(spark, sf_dir))
    return _text_day(path_problems(files, files.select("day")))


@query
def ingest_file_problems(spark, sf_dir):
    return _text_day(file_problems(_facts(spark, sf_dir)))


@query
def ingest_row_counts(spark, sf_dir):
    """Lines against rows: sound lines are written as store files, then counted again from the files' footers."""
    lines = source_lines(spark, sf_dir, faults=False)
    root = shared_dir(spark, "rows")
    data = lines.filter("block = 1 and octet_length(line) > 0")
    parts = 1 + data.count() // 500_000
    for s in STREAMS:
        write_rows(sorted_rows(data.filter(F.col("stream") == s), 6, parts), f"{root}/{s}")
    files = store_files(spark, root).select("day", "stream", "path")
    written = read_footers(files).dropDuplicates(["path"]).groupBy("day", "stream").agg(F.sum("file_rows").alias("n_rows_parquet"))
    counted = line_facts(lines).groupBy("day", "stream").agg(F.sum(F.col("n_lines") - 1).alias("n_rows_csv"))
    # by grouping, as events without a time have no day that a join could meet on
    both = counted.unionByName(written, allowMissingColumns=True)
    return _text_day(both.groupBy("day", "stream").agg(F.sum("n_rows_csv").alias("n_rows_csv"), F.sum("n_rows_parquet").alias("n_rows_parquet")))


def _ingested(spark, sf_dir):
    """A store and the outcomes of ingesting the trees of all days into it."""
    root = shared_dir(spark, "ingested")
    return root, ingest_days(spark, source_trees(spark, sf_dir), root, stop_on_error=False).outcomes


@query
def ingest_batch_outcomes(spark, sf_dir):
    """GBK trees of all events, ingested: each day's outcome; days with a faulty line fail alone."""
    _, outcomes = _ingested(spark, sf_dir)
    return _text_day(outcomes).withColumn("source", F.substring_index("source", "/", -1))


@query
def ingest_manifest(spark, sf_dir):
    """What the manifests of those days say of each stream."""
    root, _ = _ingested(spark, sf_dir)
    told = manifests(spark, root).select("day", "quality", "dropped_by_prefix", F.explode("streams").alias("s"))
    return _text_day(told).select("day", "quality", F.aggregate(F.map_values("dropped_by_prefix"), F.lit(0).cast("bigint"), lambda a, n: a + n)
                                  .alias("n_dropped"), "s.stream", "s.n_symbols", "s.n_rows_csv", "s.n_rows_parquet",
                                  "s.n_short_times", "s.header", "s.sha256_csv")


@query
def ingest_read_back(spark, sf_dir):
    """All rows of the three streams of the published days, read and decoded."""
    root, _ = _ingested(spark, sf_dir)
    store = RawStore(spark, root, parse_registry(spark, STORE_REGISTRY))
    fields = {"orders": "oid", "trades": "seq", "xinqing": "last_price"}
    rows = [store.read(ReadRequest(s, store.days("self_consistent"), ("time_ms", f))).frame.withColumnRenamed(f, "value")
            .withColumn("stream", F.lit(s)) for s, f in fields.items()]
    return _text_day(reduce(DataFrame.unionByName, rows))


@query
def ingest_again(spark, sf_dir):
    """The same trees three times more: as they were, with some files altered, and with a prefix fewer; each day's outcome."""
    trees, root = source_trees(spark, sf_dir), shared_dir(spark, "again")

    def run(name: str, prefixes=MAIN_PREFIXES):
        outcomes = ingest_days(spark, trees, root, prefixes, stop_on_error=False).outcomes
        return outcomes.select(F.lit(name).alias("run"), "day", "status", "error")

    ingest_days(spark, trees, root, stop_on_error=False)
    same = run("same")
    alter_trees(spark, sf_dir, trees)
    return _text_day(same.unionByName(run("altered")).unionByName(run("prefixes", MAIN_PREFIXES[:-1])))


def _archives(spark, sf_dir):
    k, date = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyyMMdd")
    name = F.when(k == 0, F.concat(date, F.lit(".7z"))).when(k == 1, F.concat(date, F.lit("(1).7z"))) \
        .when(k == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".7z"))) \
        .when(k == 3, F.concat(date, F.lit(".7z.downloading"))) \
        .otherwise(F.concat(F.substring(date, 1, 4), F.lit("13"), F.substring(date, 7, 2), F.lit(".7z")))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")).withColumn("day", archive_day("name"))


@query
def archive_days(spark, sf_dir):
    return _text_day(_archives(spark, sf_dir)).select("o_orderkey", "day")


@query
def archive_repeated_days(spark, sf_dir):
    return _text_day(repeated_days(_archives(spark, sf_dir)))


# ---------------------------------------------------------------- digests and run records


@query
def canonical_digests(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(canonical_frame("lang", "source", "text"), 256).alias("digest"))


@query
def digest_rollup(spark, sf_dir):
    """One digest per day and stream over a digest per symbol, each over blocks of that symbol's rows."""
    raw = raw_rows(spark, sf_dir)
    line = F.concat_ws("|", SYMBOL_COL, F.col("pos").cast("string"), F.coalesce("column_10", F.lit("")), "column_11", "column_12")
    return _text_day(content_digests(raw.select("day", "stream", F.col(SYMBOL_COL).alias("name"), "pos", line.alias("line")),
                                     ["day", "stream"], "pos"))


def _records(spark, sf_dir):
    runs = raw_rows(spark, sf_dir).groupBy("day", "stream").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return run_records(_text_day(runs), ["day", "stream", "n", "first"])


@query
def run_record_ids(spark, sf_dir):
    return _records(spark, sf_dir)


@query
def run_records_appended(spark, sf_dir):
    """A log after three appends: of the orders' records, of all, and of the quotes' once more."""
    records, log = _records(spark, sf_dir), shared_dir(spark, "records")
    for part in (records.filter("body like '%\"orders\"%'"), records, records.filter("body like '%\"xinqing\"%'")):
        appended = append_records(part, log)
    return appended.select("receipt_id", "body")


@query
def bound_files(spark, sf_dir):
    """Files of up to 256 lines of a stream, against digests of their lines: some files lack, some differ, some have moved."""
    root = qualified(spark, shared_dir(spark, "bound"))
    n = F.col("n")
    lines = raw_rows(spark, sf_dir).select(
        "stream", F.call_function("div", "pos", F.lit(256)).alias("n"), F.col("pos").alias("place"),
        F.concat_ws(",", F.col("pos").cast("string"), SYMBOL_COL).alias("line"))
    name = F.concat("stream", F.lit("/"), n, F.lit(".csv"))
    put = F.when(n % 7 == 3, F.concat(F.lit("elsewhere/"), name)).otherwise(name)
    written = lines.filter(n % 5 != 1)
    line = F.when(n % 4 == 2, F.concat(F.lit("altered "), "line")).otherwise(F.col("line"))
    write_lines(written.select(F.concat_ws("/", F.lit(root), put).alias("path"), "place", line.alias("line"))).count()
    listed = list_files(spark, [root]).select(F.concat("root", F.lit("/"), "rel").alias("full"), F.col("rel").alias("path"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda p: F.concat(p["line"], F.lit("\n"))), "")
    expected = lines.groupBy("stream", "n").agg(F.sha2(text, 256).alias("sha256")).select(name.alias("path"), "sha256")
    return bound_file_problems(expected, with_digests(listed, "full").select("path", "sha256"))


@query
def run_record_conflicts(spark, sf_dir):
    """Records against a log in which the orders' bodies were altered."""
    records = _records(spark, sf_dir)
    log = records.withColumn("body", F.replace("body", F.lit('"orders"'), F.lit('"order"')))
    return record_conflicts(records, log)
