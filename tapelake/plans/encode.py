"""Raw text rows, registries, source trees and archive names, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.operators.ingest import write_rows
from tapelake.operators.registry_rules import DEFECT_CODES
from tapelake.schema import CSV_NAME, STREAMS, SYMBOL_COL
from tapelake.session import qualified, shared_dir
from tapelake.sources.files import write_lines
from tapelake.sources.raw_store import index_store

WIDTH = {"orders": 11, "trades": 13, "xinqing": 67}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], n: Column) -> Column:
    """The n-th of a few fixed values, counted from zero."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def stream_of_event() -> Column:
    return F.when(F.col("event_type").isin("click", "signup"), "orders") \
        .when(F.col("event_type").isin("view", "error"), "trades").otherwise("xinqing")


def symbol_of(user: str) -> Column:
    number = F.lpad((F.col(user) % 1_000_000).cast("string"), 6, "0")
    return F.concat(number, F.when(F.col(user) % 2 == 0, ".SZ").otherwise(".SH"))


def clock_number() -> Column:
    """HHMMSSmmm as one number."""
    millis = (F.date_part(F.lit("SECOND"), "ts") * 1000).cast("bigint")
    return F.hour("ts") * 10_000_000 + F.minute("ts") * 100_000 + millis


def time_text() -> Column:
    """HHMMSSmmm without the leading zero before ten o'clock."""
    full = F.lpad(clock_number().cast("string"), 9, "0")
    return F.when(F.hour("ts") < 10, F.substring(full, 2, 8)).otherwise(full)


def odd_time_text() -> Column:
    """The same clock in six ways: plain, padded, without milliseconds (two ways), one digit too long, missing."""
    short = F.lpad(F.call_function("div", clock_number(), F.lit(1000)).cast("string"), 6, "0")
    short = F.when(F.hour("ts") < 10, F.substring(short, 2, 5)).otherwise(short)
    way = F.col("event_id") % 6
    return F.when(way == 0, F.concat(F.lit(" \t"), time_text(), F.lit(" "))).when(way == 1, short) \
        .when(way == 2, F.concat(F.lit(" "), short)).when(way == 3, F.concat(F.lpad(clock_number().cast("string"), 9, "0"), F.lit("0"))) \
        .when(way == 4, F.lit(None)).otherwise(time_text())


def price_text() -> Column:
    """The value in ten-thousandths as text, some of them in the odd shapes real data has."""
    way = F.col("event_id") % 16
    odd = ("", " ", "\x00", "1.2018e+006", "9007199254740993", "18446744073709551615", " 42 ", "-1.5e+02", "1d", "2151938037")
    plain = F.round(F.col("value") * 10_000).cast("bigint").cast("string")
    return F.when(way < len(odd), pick(odd, F.least(way, F.lit(len(odd) - 1)))).otherwise(plain)


def raw_rows(spark: SparkSession, sf_dir: str, time: Column | None = None) -> DataFrame:
    """Every event as one raw row of its stream: day, stream, pos, ``_symbol`` and text columns."""
    return _as_raw(table(spark, sf_dir, "events"), time)


def _as_raw(e: DataFrame, time: Column | None = None, *kept: str) -> DataFrame:
    cells = {1: symbol_of("user_id"), 2: F.lpad((F.col("user_id") % 1_000_000).cast("string"), 6, "0"),
             3: F.date_format(F.to_date("ts"), "yyyyMMdd"), 4: time_text() if time is None else time, 5: price_text(),
             6: F.col("event_id").cast("string"), 7: F.upper(F.substring("event_type", 1, 1)),
             8: F.when(F.col("event_id") % 8 == 0, "\x00").when(F.col("event_id") % 8 == 1, " ").otherwise(F.substring("event_type", 2, 1)),
             9: price_text(), 10: F.regexp_extract("props", "([0-9]+)", 1), 11: F.col("user_id").cast("string"),
             12: (F.col("event_id") % 1000).cast("string"), 13: F.lit("")}
    return e.select(F.to_date("ts").alias("day"), stream_of_event().alias("stream"), F.col("event_id").alias("pos"),
                    symbol_of("user_id").alias(SYMBOL_COL), *[c.alias(f"column_{i}") for i, c in cells.items()], *kept)


_STORES: dict[tuple, str] = {}
#: Cells of a stream that one task sorts and writes.
_CELLS_PER_TASK = 4_000_000


def altered_rows(rows: DataFrame) -> DataFrame:
    """Raw rows with some cells changed, some emptied and some rows lost."""
    p = F.col("pos")
    return rows.filter(p % 1999 != 7).withColumns({
        "column_9": F.when(p % 97 == 0, "changed").otherwise(F.col("column_9")),
        "column_8": F.when(p % 89 == 1, F.lit(None)).otherwise(F.col("column_8")),
        "column_10": F.when(p % 83 == 2, F.lit(None)).otherwise(F.col("column_10"))})


def event_store(spark: SparkSession, sf_dir: str, parts: int | None = None, altered: bool = False) -> str:
    """A raw store of all events in the shared folder, written once per application, in about ``parts`` part files a stream.

    Events are sorted as they are and become text behind the sort, so what a task reads does not grow with a stream's width.
    """
    key = (spark.sparkContext.applicationId, sf_dir, parts, altered)
    if key not in _STORES:
        root = shared_dir(spark, "events")
        events = table(spark, sf_dir, "events").withColumns({
            "date": F.date_format("ts", "yyyyMMdd").cast("int"), SYMBOL_COL: symbol_of("user_id"), "stream": stream_of_event()})
        order = ["date", SYMBOL_COL, "event_id"]
        base = F.col("column_11").cast("bigint")
        ladder = {f"column_{i}": (base * 10 + i).cast("string") for i in range(14, WIDTH["xinqing"] + 1)}
        sizes = {r["stream"]: r["count"] for r in events.groupBy("stream").count().collect()}
        for stream in STREAMS:
            names = [f"column_{i}" for i in range(1, WIDTH[stream] + 1)]
            n = parts or 1 + sizes.get(stream, 0) * WIDTH[stream] // _CELLS_PER_TASK
            spread = events.filter(F.col("stream") == stream).repartitionByRange(n, *order).sortWithinPartitions(*order)
            rows = _as_raw(spread, None, "date")
            rows = altered_rows(rows) if altered else rows
            rows = rows.withColumns(ladder) if stream == "xinqing" else rows
            write_rows(rows.select(*names, SYMBOL_COL, "date"), f"{root}/{stream}")
        index_store(spark, root)
        _STORES[key] = root
    return _STORES[key]


# ---------------------------------------------------------------- registries from parts


def _some_days() -> Column:
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 30).cast("int"))
    second = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_size") % 30).cast("int"))
    return F.array_distinct(F.array(first.cast("string"), second.cast("string")))


def part_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry entry per part, free of faults apart from supersede chains."""
    k = F.col("p_partkey")
    status = pick(("active", "pending", "rejected", "active", "active"), k % 5)
    scoped = k % 4 != 0
    action = F.when(~scoped, "none").otherwise(pick(("patch", "gap", "none"), k % 3))
    return table(spark, sf_dir, "part").select(
        k.cast("int").alias("pos"), F.concat(F.lit("P"), k).alias("id"), pick(DEFECT_CODES, k % len(DEFECT_CODES)).alias("code"),
        F.lit("defect").alias("kind"), F.when(F.col("p_size") % 4 > 0, pick(("x", *STREAMS), F.col("p_size") % 4)).alias("stream"),
        F.when(scoped, _some_days()).alias("days"), status.alias("status"), F.lit(None).cast("string").alias("superseded_by"),
        F.lit("2024-01-01").alias("created_at"), F.col("p_name").alias("evidence"), F.sha2("p_name", 256).alias("evidence_sha256"),
        F.lit(None).cast("string").alias("decision_ref"), F.lit(None).cast("string").alias("decision_sha256"),
        action.alias("read_layer_action"), F.col("p_type").alias("note"))


def faulty_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same entries with a fault of one kind in some of them."""
    k = F.col("pos")
    return part_registry(spark, sf_dir).withColumns({
        "id": F.when(k % 101 == 3, F.lit("P3")).otherwise(F.col("id")),
        "kind": F.when(k % 103 == 4, F.lit("odd")).when(k % 107 == 5, F.lit("shape")).otherwise(F.col("kind")),
        "stream": F.when(k % 109 == 6, F.lit("bonds")).otherwise(F.col("stream")),
        "code": F.when(k % 113 == 7, F.lit("no_such_code")).when(k % 127 == 8, F.lit(None)).otherwise(F.col("code")),
        "superseded_by": F.when(k % 131 == 9, F.lit("P1")),
        "created_at": F.when(k % 137 == 10, F.lit("2024-1-1")).otherwise(F.col("created_at")),
        "days": F.when(k % 139 == 11, F.array(F.lit("2024-02-30"))).when(k % 149 == 12, F.lit(None)).otherwise(F.col("days")),
        "evidence_sha256": F.when(k % 151 == 13, F.upper("evidence_sha256")).otherwise(F.col("evidence_sha256")),
        "decision_sha256": F.when(k % 157 == 14, F.lit("short"))})


def chained_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that point at half their number: long chains, some of them broken, circular or dead at the end."""
    k = F.col("p_partkey")
    pointer = F.when(k % 97 == 0, F.lit(None)).when(k % 89 == 1, F.concat(F.lit("X"), k)) \
        .when(k % 83 == 2, F.concat(F.lit("P"), k)).when(k > 0, F.concat(F.lit("P"), F.call_function("div", k, F.lit(2))))
    status = F.when(k % 79 == 3, "rejected").when(pointer.isNotNull(), "superseded").when(k % 5 == 0, "superseded").otherwise("active")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), k).alias("id"), status.alias("status"),
                                               pointer.alias("superseded_by"))


def earlier_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same entries, some of them with a decision or a successor."""
    k = F.col("pos")
    return part_registry(spark, sf_dir).withColumns({
        "decision_ref": F.when(k % 4 == 1, F.lit("docs/first.md")), "decision_sha256": F.when(k % 4 == 1, F.sha2("id", 256)),
        "superseded_by": F.when(k % 4 == 2, F.lit("P1"))})


def later_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later snapshot: entries deleted, added and changed, lawfully and not, each column in some of them."""
    k = F.col("pos")
    old = earlier_registry(spark, sf_dir)
    changed = old.filter(k % 61 != 1).withColumns({
        "status": F.when(k % 7 == 0, pick(("superseded", "active", "rejected", "pending", "superseded"), k % 5)).otherwise(F.col("status")),
        "note": F.when(k % 59 == 2, F.lit("another story")).otherwise(F.col("note")),
        "stream": F.when(k % 53 == 3, F.lit(None)).otherwise(F.col("stream")),
        "days": F.when(k % 47 == 4, F.array(F.lit("2024-03-01"))).when(k % 43 == 5, F.array_append("days", F.lit("2024-03-01")))
        .otherwise(F.col("days")),
        "decision_ref": F.when(k % 41 == 6, F.lit("docs/d.md")).otherwise(F.col("decision_ref")),
        "decision_sha256": F.when(k % 43 == 7, F.lit("f" * 64)).otherwise(F.col("decision_sha256")),
        "superseded_by": F.when(k % 47 == 9, F.lit("P2")).otherwise(F.col("superseded_by")),
        "code": F.when(k % 67 == 1, F.lit("no_such_code")).otherwise(F.col("code")),
        "kind": F.when(k % 71 == 2, F.lit("shape")).otherwise(F.col("kind")),
        "created_at": F.when(k % 73 == 3, F.lit("2024-01-02")).otherwise(F.col("created_at")),
        "evidence": F.when(k % 79 == 4, F.lit("elsewhere")).otherwise(F.col("evidence")),
        "evidence_sha256": F.when(k % 83 == 5, F.lit("0" * 64)).otherwise(F.col("evidence_sha256")),
        "read_layer_action": F.when(k % 89 == 8, F.lit("other")).otherwise(F.col("read_layer_action"))})
    fresh = old.filter(k % 37 == 0).withColumn("id", F.concat(F.lit("N"), k))
    return changed.unionByName(fresh)


# ---------------------------------------------------------------- source trees from events

PREFIXES = ("000", "300", "600", "688", "001", "603", "002", "605", "003", "301")


def _listed_symbol() -> Column:
    u = F.col("user_id")
    number = F.lpad((F.call_function("div", u, F.lit(10)) % 1000).cast("string"), 3, "0")
    return F.concat(pick(PREFIXES, u % 10), number, F.when(u % 2 == 0, ".SZ").otherwise(".SH"))


def _header(stream: str) -> str:
    return f"万得代码,{stream},时间,c4,c5,"


def _emptied() -> Column:
    """Files of no bytes: quotes of some users, which is legal, and orders of others, which is not."""
    u = F.col("user_id") % 50
    return ((u == 10) & (F.col("stream") == "xinqing")) | ((u == 11) & (F.col("stream") == "orders"))


def _header_text() -> Column:
    drifted = (F.col("user_id") % 50 == 13) & (F.col("stream") == "trades")
    return F.when(drifted, _header("traded")).otherwise(pick(tuple(_header(s) for s in STREAMS),
                                                             F.array_position(F.array(*[F.lit(s) for s in STREAMS]), F.col("stream")) - 1))


def _listed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("day"), stream_of_event().alias("stream"), _listed_symbol().alias("symbol"),
        F.col("event_id").alias("seq"), time_text().alias("t"), price_text().alias("p"), "user_id")


def source_lines(spark: SparkSession, sf_dir: str, faults: bool = True) -> DataFrame:
    """The lines of one CSV per day, symbol and stream: a header, one line per event, blank lines, some faulty lines."""
    e = _listed_events(spark, sf_dir)
    e = e.filter(~_emptied()) if faults else e
    whole = F.concat_ws(",", "symbol", F.lit("x"), "t", "p", F.col("seq").cast("string"), F.lit(""))
    e = e.withColumn("fields", F.explode(F.array(whole)))       # made once a line, not once for every fault
    fields = F.col("fields")
    faulty = F.when(F.col("seq") % 997 == 5, F.concat(fields, F.lit("é"))).when(F.col("seq") % 991 == 6, F.concat(F.lit('"'), fields)) \
        .when(F.col("seq") % 983 == 7, F.lit("a,b")).when(F.col("seq") % 977 == 8, F.concat(F.lit("\r"), fields))
    text = F.coalesce(faulty, fields) if faults else fields
    keys = ["day", "stream", "symbol"]
    body = e.select(*keys, F.lit(1).cast("bigint").alias("block"), "seq", text.alias("line"))
    blank = body.filter(F.col("seq") % 10 == 0).withColumn("line", F.lit(""))
    # users ten thousand apart share a symbol, and so a file and its header
    head = e.groupBy(*keys).agg(F.min(_header_text()).alias("line")).select(
        *keys, F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("seq"), "line")
    return head.unionByName(body).unionByName(blank)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files those lines come from, empty ones and strays included."""
    seen = _listed_events(spark, sf_dir).select("day", "stream", "symbol", "user_id").distinct()
    name = pick(tuple(CSV_NAME[s] for s in STREAMS), F.array_position(F.array(*[F.lit(s) for s in STREAMS]), F.col("stream")) - 1)
    day = F.date_format("day", "yyyyMMdd")
    files = seen.select("day", F.concat_ws("/", day, "symbol", name).alias("rel"),
                        F.when(_emptied(), 0).otherwise(100).cast("bigint").alias("length"),
                        F.when(_emptied(), "").otherwise(_header_text()).cast("binary").alias("header"))
    u = F.col("user_id") % 50
    sundry = F.when(u == 7, F.concat_ws("/", day, "symbol", F.lit("readme.txt"))) \
        .when(u == 8, F.concat_ws("/", F.lit("a"), day, "symbol", name)) \
        .when(u == 9, F.concat_ws("/", F.concat(F.lit("X"), "symbol"), name))
    strays = seen.select("day", F.explode(F.array(sundry)).alias("rel")).filter("rel is not null").select(
        "day", "rel", F.lit(1).cast("bigint").alias("length"), F.lit("x").cast("binary").alias("header"))
    return files.unionByName(strays.distinct())


def _tree_symbol() -> Column:
    """Twenty symbols whatever the number of users, so that files grow with the data and not their number."""
    u = F.col("user_id") % 20
    number = F.lpad(u.cast("string"), 3, "0")
    return F.concat(pick(PREFIXES, u % 10), number, F.when(u % 2 == 0, ".SZ").otherwise(".SH"))


def _tree_rows(spark: SparkSession, sf_dir: str, root: str, altered: bool) -> DataFrame:
    """(path, place, line, changed) of the trees' files; ``altered`` gives the lines that are changed on even days another text."""
    e = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyyMMdd").alias("ymd"), stream_of_event().alias("stream"), _tree_symbol().alias("symbol"),
        F.col("event_id").alias("place"), time_text().alias("t"), price_text().alias("p"), F.dayofmonth("ts").alias("d"))
    changed = (F.col("d") % 2 == 0) & (F.col("place") % 61 == 7)
    mark = F.when(changed, "y").otherwise("x") if altered else F.lit("x")
    spoilt = F.when((F.col("d") % 7 == 3) & (F.col("place") % 50 == 0), '"').otherwise("")
    line = F.concat_ws(",", "symbol", mark, "ymd", "t", "p", F.concat(F.col("place").cast("string"), spoilt))
    every = F.array(*[F.struct(F.lit(s).alias("stream"), F.lit(f"万得代码,{s},日期,时间,价格,编号").alias("line")) for s in STREAMS])
    heads = e.select("ymd", "symbol").distinct().select("ymd", "symbol", F.lit(-1).cast("bigint").alias("place"),
                                                        F.explode(every).alias("s")).select("ymd", "symbol", "place", "s.*")
    rows = e.select("ymd", "symbol", "place", "stream", line.alias("line"), changed.alias("changed")) \
        .unionByName(heads.withColumn("changed", F.lit(False)))
    csv = pick(tuple(CSV_NAME[s] for s in STREAMS), F.array_position(F.array(*[F.lit(s) for s in STREAMS]), F.col("stream")) - 1)
    path = F.concat_ws("/", F.lit(root), F.concat("ymd", F.lit(".7z")), "ymd", "symbol", csv)
    return rows.select(path.alias("path"), "place", "line", "changed")


def source_trees(spark: SparkSession, sf_dir: str) -> list[str]:
    """GBK trees of all events in the shared folder, one a day, ``YYYYMMDD.7z/YYYYMMDD/symbol/csv``; their paths by day.

    Every symbol of a day has all three files, some with a header alone. On days of the month 3, 10, 17, 24 and 31 every
    fiftieth event's line holds a quote.
    """
    root = qualified(spark, shared_dir(spark, "trees"))
    written = write_lines(_tree_rows(spark, sf_dir, root, altered=False))
    tree = F.substring_index("path", "/", -4)
    days = written.select(F.substring_index(tree, "/", 1).alias("tree")).distinct().collect()
    return sorted(f"{root}/{r['tree']}" for r in days)


def alter_trees(spark: SparkSession, sf_dir: str, trees: list[str]) -> int:
    """Write those files of the trees anew that hold a changed line; how many."""
    rows = _tree_rows(spark, sf_dir, trees[0].rsplit("/", 1)[0], altered=True)
    return write_lines(rows.join(rows.filter("changed").select("path").distinct(), "path", "left_semi")).count()
