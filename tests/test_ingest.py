"""Source trees to stores and back."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pyarrow.parquet as pq
import pytest

from tapelake.operators.audit import compare_stores
from tapelake.operators import ingest as ingest_module
from tapelake.operators.content_digest import content_digests
from tapelake.operators.ingest import ingest, ingest_days, manifests
from tapelake.schema import CSV_NAME, ROW_GROUP_ROWS, ReadRequest
from tapelake.sources.csv_tree import SourceError
from tapelake.sources.files import bound_file_problems, digest_problems
from tapelake.sources.raw_store import RawStore
from tapelake.sources.registry import parse_registry
from tapelake.sources import run_log
from tapelake.sources.snapshots import snapshot, versions
from tapelake.sources.run_log import RecordConflict, append_records, run_records
from tests.conftest import PLAIN, REGISTRY, header, put_source, source_files

ORDERS, TRADES, QUOTES = (CSV_NAME[s] for s in ("orders", "trades", "xinqing"))
COUNTS = {"600519.SH": 5, "300750.SZ": 2, "000858.SZ": 3, "688981.SH": 1, "601318.SH": 6}


def market_day(tmp_path):
    """A day with dropped prefixes, a symbol with quotes only, a quote file without bytes, a NUL cell and two line ends."""
    files = source_files(COUNTS | {"002415.SZ": 4})
    del files["002415.SZ", ORDERS], files["002415.SZ", TRADES]
    files["601318.SH", QUOTES] = b""
    files["600519.SH", TRADES] = files["600519.SH", TRADES].replace(b",6002,", b",\x00,")
    files["000858.SZ", ORDERS] = files["000858.SZ", ORDERS].replace(b"\n", b"\r\n") + b"\r\n\r\n"
    return files, put_source(tmp_path / "source", files, PLAIN)


def lines_of(files, name):
    """What a stream's table must hold: cells and symbol of every line of the kept symbols, in symbol order."""
    kept = sorted((s, data) for (s, n), data in files.items() if n == name and s[:3] not in ("300", "688"))
    return [(*line.decode().split(","), s) for s, data in kept for line in data.split()[1:]]


def published(root):
    return sorted(p for p in root.rglob("part-*.parquet") if "_index" not in p.parts)


def test_tables_hold_the_lines(spark, tmp_path, market):
    files, source = market_day(tmp_path)
    receipt = ingest(spark, PLAIN, source, str(market)).first()
    for s in receipt["streams"]:
        want = lines_of(files, CSV_NAME[s["stream"]])
        (folder,) = (market / s["stream"]).glob(f"v=*/date={PLAIN:%Y%m%d}")
        table = pq.read_table(folder, partitioning=None)
        assert list(zip(*table.to_pydict().values())) == want
        assert table.column_names == [*(f"column_{i}" for i in range(1, table.num_columns)), "_symbol"]
        assert s["n_rows_csv"] == s["n_rows_parquet"] == len(want) and s["n_symbols"] == len({r[-1] for r in want})
        assert s["header"] == header(s["stream"]).decode("gbk")
    assert receipt["dropped_by_prefix"] == {"300": 1, "688": 1} and receipt["quote_only_symbols"] == ["002415.SZ"]
    assert receipt["empty_files"] == [["601318.SH", "xinqing"]] and receipt["quality"] == "self_consistent"
    store = RawStore(spark, str(market), parse_registry(spark, REGISTRY))
    got = store.read(ReadRequest("trades", (PLAIN,), ("code", "seq", "time_ms"), symbols=frozenset({"600519.SH", "002415.SZ"})))
    assert [tuple(r)[2:] for r in got.ordered().collect()] == [
        ("\x00" if k == 2 else str(6000 + k), 5000 + k, 50_400_000 + 1000 * k) for k in range(5)]
    assert [g["symbol"] for g in got.gaps.collect()] == ["002415.SZ"] and store.days("self_consistent") == (PLAIN,)


def test_content_digest_follows_from_the_bytes(spark, tmp_path, market):
    files, source = market_day(tmp_path)
    stated = {s["stream"]: s["sha256_csv"] for s in ingest(spark, PLAIN, source, str(market)).first()["streams"]}
    total = hashlib.sha256()
    for symbol in sorted({s for s, n in files if n == TRADES} - {"300750.SZ", "688981.SH"}):
        head, _, body = files[symbol, TRADES].partition(b"\n")
        one = hashlib.sha256()
        for piece in (symbol.encode(), head.decode("gbk").encode(), body):
            one.update(b"%d\0%s" % (len(piece), piece))
        total.update(f"{symbol}\0{one.hexdigest()}\n".encode())
    assert stated["trades"] == total.hexdigest()


def test_a_day_is_bound_to_its_source(spark, tmp_path, market):
    _, source = market_day(tmp_path)
    receipt = ingest(spark, PLAIN, source, str(market)).first()
    written = {p: p.stat().st_mtime_ns for p in market.rglob("*")}
    assert ingest(spark, PLAIN, source, str(market)).first() == receipt
    assert {p: p.stat().st_mtime_ns for p in market.rglob("*")} == written
    with pytest.raises(SourceError, match="prefixes"):
        ingest(spark, PLAIN, source, str(market), prefixes=("600",))
    other = put_source(tmp_path / "other", source_files({"600519.SH": 4}), PLAIN)
    with pytest.raises(SourceError, match="another sha256"):
        ingest(spark, PLAIN, other, str(market))
    ingest(spark, PLAIN, source, str(tmp_path / "again"))
    assert all(r["identical_modulo_null"] for r in compare_stores(spark, str(market), str(tmp_path / "again"), PLAIN).collect())
    with published(market)[0].open("ab") as file:
        file.write(b"more")
    with pytest.raises(Exception):
        ingest(spark, PLAIN, source, str(market))


def test_only_changed_sources_are_hashed_again(spark, tmp_path, market, monkeypatch):
    files, source = market_day(tmp_path)
    opened = []
    hashed = ingest_module._hashed

    def counted(rows):
        opened.append(sorted(r["rel"] for r in rows.collect()))
        return hashed(rows)

    monkeypatch.setattr(ingest_module, "_hashed", counted)
    ingest(spark, PLAIN, source, str(market))
    assert [len(names) for names in opened] == [len(files)]
    ingest(spark, PLAIN, source, str(market))
    assert len(opened) == 1
    ingest(spark, PLAIN, source, str(market), rehash=True)
    assert [len(names) for names in opened] == [len(files)] * 2
    folder = tmp_path / "source" / f"{PLAIN:%Y%m%d}"
    changed = folder / "600519.SH" / ORDERS
    changed.write_bytes(changed.read_bytes().replace(b"1", b"2"))
    (folder / "601318.SH" / TRADES).rename(folder / "601318.SH" / "spare.csv")
    with pytest.raises(SourceError) as error:
        ingest(spark, PLAIN, source, str(market))
    day = f"{PLAIN:%Y%m%d}"
    assert f"another sha256: {day}/600519.SH/{ORDERS} altered (3 in all)" in str(error.value)
    assert opened[2:] == [[f"{day}/600519.SH/{ORDERS}", f"{day}/601318.SH/spare.csv"]]
    now = ingest_module._digested(spark, {PLAIN: source}, str(market), False)
    changes = ingest_module.source_changes(now, str(market), snapshot(spark, str(market)).runs)
    assert {(r["rel"].split("/", 1)[1], r["change"]) for r in changes.collect()} == {
        (f"600519.SH/{ORDERS}", "altered"), (f"601318.SH/{TRADES}", "missing"), ("601318.SH/spare.csv", "added")}


def test_headers_alone_make_an_empty_day(spark, tmp_path, market):
    ingest(spark, PLAIN, put_source(tmp_path / "flat", source_files({"600519.SH": 0})), str(market))
    store = RawStore(spark, str(market), parse_registry(spark, REGISTRY))
    got = store.read(ReadRequest("xinqing", (PLAIN,), ("last_price",), symbols=frozenset({"600519.SH"})))
    assert got.frame.count() == 0 and [g["reason"] for g in got.gaps.collect()] == ["symbol_absent"] and store.days() == (PLAIN,)


def test_row_groups_have_the_fixed_size(spark, tmp_path, market):
    files = source_files({"600519.SH": 1, "601318.SH": 3})
    first = files["600519.SH", TRADES].split(b"\n")
    files["600519.SH", TRADES] = b"\n".join([first[0], *[first[1]] * (ROW_GROUP_ROWS + 500), b""])
    ingest(spark, PLAIN, put_source(tmp_path / "s", files), str(market))
    (footer,) = [pq.read_metadata(p) for p in published(market / "trades")]
    assert [footer.row_group(g).num_rows for g in range(footer.num_row_groups)] == [ROW_GROUP_ROWS, 503]


def changed(symbol, name, change):
    return lambda files: files.update({(symbol, name): change(files[symbol, name])})


def without(name, *symbols):
    return lambda files: [files.pop((s, name)) for s in symbols]


#: Rule named by the error, and what breaks it.
BREAKS = [
    ("not ASCII", changed("600519.SH", TRADES, lambda d: d + "600519.SH,价\n".encode("gbk"))),
    ("quote", changed("000858.SZ", QUOTES, lambda d: d.replace(b",9001,", b',"9001",'))),
    ("field count", changed("000858.SZ", ORDERS, lambda d: d.replace(b",9001,", b","))),
    ("line break", changed("600519.SH", ORDERS, lambda d: d.replace(b",8001,", b",80\r01,"))),
    ("no header", changed("000858.SZ", TRADES, lambda d: b" \t")),
    ("no header", changed("000858.SZ", QUOTES, lambda d: b"\n\n")),
    ("empty file", changed("600519.SH", TRADES, lambda d: b"")),
    ("headers differ", changed("600519.SH", QUOTES, lambda d: d.replace("字段5,".encode("gbk"), "字段五,".encode("gbk")))),
    ("not GBK", lambda files: files.update({(s, QUOTES): b"\x81\xff" + files[s, QUOTES] for s in ("600519.SH", "000858.SZ")})),
    ("file name", lambda files: files.update({("600519.SH", "orders.csv"): b"1"})),
    ("unregistered path", lambda files: files.update({("600519.SH/old", ORDERS): files["600519.SH", ORDERS]})),
    ("malformed symbol", lambda files: files.update({("60051.SH", n): files["600519.SH", n] for n in (ORDERS, TRADES, QUOTES)})),
    ("lacks a stream", without(ORDERS, "000858.SZ")),
    ("all files", lambda files: files.update({(s, QUOTES): b"" for s in ("600519.SH", "000858.SZ")})),
    ("stream without any file", lambda files: [without(n, "600519.SH", "000858.SZ")(files) for n in (ORDERS, TRADES)]),
]


def test_bad_days_fail_alone_and_name_their_rule(spark, tmp_path, market):
    days = [dt.date(2023, 6, 1) + dt.timedelta(days=i) for i in range(len(BREAKS) + 1)]
    sources = []
    for day, (_, spoil) in zip(days, [*BREAKS, ("", lambda files: None)]):
        files = source_files({"600519.SH": 3, "000858.SZ": 2})
        files["600519.SH", ORDERS] += b"\n\n\n"
        spoil(files)
        sources.append(put_source(tmp_path / f"{day:%Y%m%d}.7z", files, day))
    got = ingest_days(spark, sources, str(market), stop_on_error=False)
    outcomes = {r["day"]: r for r in got.outcomes.collect()}
    assert not got.ok and outcomes[days[-1]]["status"] == "ok"
    for day, (rule, _) in zip(days, BREAKS):
        assert outcomes[day]["status"] == "failed" and rule in outcomes[day]["error"], (rule, outcomes[day])
    assert [r["day"] for r in manifests(spark, str(market)).collect()] == days[-1:]
    assert {p.parent.name for p in published(market)} == {f"date={days[-1]:%Y%m%d}"}


def test_batches_stop_at_the_first_failure(spark, tmp_path, market):
    good, bad, late = (source_files({"601318.SH": 1}) for _ in range(3))
    bad["601318.SH", TRADES] = b""
    sources = [put_source(tmp_path / name, files) for name, files in (
        ("20230612.7z", good), ("20230613.7z", bad), ("20230614.7z", late), ("20230612 copy.7z", good))]
    got = ingest_days(spark, sources, str(market))
    assert {str(r["day"]): r["status"] for r in got.outcomes.collect()} == {"2023-06-12": "ok", "2023-06-13": "failed"}
    assert not got.ok and [r["source"] for r in got.skipped.collect()] == sources[3:]
    assert [str(r["day"]) for r in manifests(spark, str(market)).collect()] == ["2023-06-12"]
    with pytest.raises(ValueError, match="20230612"):
        ingest_days(spark, [sources[0], put_source(tmp_path / "b" / "20230612.7z", good)], str(market))
    assert ingest_days(spark, sources[:1], str(market)).ok


def test_ascii_header_is_told_from_the_body(spark, tmp_path, market):
    def source(name, orders):
        texts = {ORDERS: orders, TRADES: b"p,q\n3,4", QUOTES: b"p,q\n5,6"}
        return put_source(tmp_path / name, {("600519.SH", n): data for n, data in texts.items()})
    streams = ingest(spark, PLAIN, source("plain", b"p,q\n1,2"), str(market)).first()["streams"]
    assert [s["n_rows_parquet"] for s in streams] == [1, 1, 1]
    with pytest.raises(SourceError, match="repeats the header"):
        ingest(spark, PLAIN, source("twice", b"p,q\n1,2\np,q"), str(tmp_path / "again"))


def test_file_digests_and_run_records(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"v1")
    (tmp_path / "b").write_bytes(b"v2")
    sha = hashlib.sha256(b"v1").hexdigest()
    expected = spark.createDataFrame([(f"file:{tmp_path}/{n}", sha) for n in "abc"], "path string, sha256 string")
    assert {(r["path"][-1], r["problem"]) for r in digest_problems(expected, "evidence").collect()} == {
        ("b", "evidence altered"), ("c", "evidence missing")}
    runs = spark.createDataFrame([("scan", 1, None), ("scan", 1, None), ("compare", 2, "x")], "kind string, n int, note string")
    records = run_records(runs, ["note", "kind", "n"])
    log = str(tmp_path / "log")
    assert append_records(records, log).count() == 2 and append_records(records, log).count() == 2
    row = records.filter("body like '%scan%'").first()
    assert row["body"] == '{"kind":"scan","n":1,"note":null}'
    assert row["receipt_id"] == hashlib.sha256(row["body"].encode()).hexdigest()
    for p in (tmp_path / "log").glob("batch=*/part-*.json"):
        p.write_text(p.read_text().replace("scan", "scat"))
    for p in (tmp_path / "log").glob("batch=*/.part-*.crc"):
        p.unlink()
    with pytest.raises(RecordConflict):
        append_records(records, log)


def test_two_writers_of_records_meet(spark, tmp_path, monkeypatch):
    """A writer appends between another's look at the log and its rename: each id is in once, a conflict is seen."""
    def records(*rows):
        return spark.createDataFrame(rows, "receipt_id string, body string")

    def record(text):
        return hashlib.sha256(text.encode()).hexdigest(), text

    log, whole = str(tmp_path / "log"), run_log.claim
    a, b, c = map(record, "abc")

    def overtaken(other):
        def first(spark, log, version, content):
            monkeypatch.setattr(run_log, "claim", whole)
            append_records(other, log)
            return whole(spark, log, version, content)
        monkeypatch.setattr(run_log, "claim", first)

    overtaken(records(b, c))
    got = append_records(records(a, b, b), log)
    assert sorted((r["receipt_id"], r["body"]) for r in got.collect()) == sorted([a, b, c])
    assert versions(spark, log) == [1, 2] and len(list((tmp_path / "log").glob("batch=*"))) == 2
    overtaken(records((a[0][::-1], "x")))
    with pytest.raises(RecordConflict):
        append_records(records((a[0][::-1], "y")), log)

    def dies(*args):
        raise KeyboardInterrupt

    log = str(tmp_path / "other")
    append_records(records(a), log)
    monkeypatch.setattr(run_log, "claim", dies)
    with pytest.raises(KeyboardInterrupt):
        append_records(records(b), log)
    assert [r["body"] for r in run_log.log_records(spark, log).collect()] == ["a"]


def test_bound_files_are_found_by_content(spark):
    def frame(*rows):
        return spark.createDataFrame(rows, "path string, sha256 string")

    expected = frame(("a", "1"), ("b", "2"), ("c", "3"), ("d", "1"), ("e", "5"), ("e", "5"), ("g", "7"))
    files = frame(("a", "1"), ("b", "9"), ("d", "8"), ("x", "3"), ("w", "3"), ("z", None), ("g", None))
    got = {tuple(r) for r in bound_file_problems(expected, files).collect()}
    # content expected at "a" and found there is no trace of "d"
    assert got == {("b", "altered", None), ("c", "moved", "w"), ("d", "altered", None), ("e", "missing", None), ("g", "missing", None)}
    assert bound_file_problems(expected.limit(0), files).count() == 0
    assert bound_file_problems(expected, files.limit(0)).filter("problem = 'missing'").count() == 6


def test_a_miscounted_day_fails_alone(spark, tmp_path, market, monkeypatch):
    """Rows lost on the way to staging show in the count: that day stays out of the store, the other is published."""
    sound = ingest_module._write_streams

    def losing(lines, *rest):
        sound(lines.filter("not (day = '2023-06-20' and stream = 'trades' and line like '%,5001,%')"), *rest)

    monkeypatch.setattr(ingest_module, "_write_streams", losing)
    days = [dt.date(2023, 6, 20), dt.date(2023, 6, 21)]
    sources = [put_source(tmp_path / f"{d:%Y%m%d}.7z", source_files({"600519.SH": 3}), d) for d in days]
    got = ingest_days(spark, sources, str(market), stop_on_error=False)
    assert {r["day"]: r["error"] for r in got.outcomes.collect()} == {days[0]: "trades: 3 lines, 2 rows", days[1]: None}
    assert {p.parent.name for p in published(market)} == {"date=20230621"}
    assert [r["day"] for r in manifests(spark, str(market)).collect()] == days[1:]


def test_content_digest_is_over_blocks(spark):
    rows = [("a", 1, "x"), ("a", 4095, None), ("a", 4096, "y"), ("b", 9000, "z")]
    frame = spark.createDataFrame([("k", n, p, text) for n, p, text in reversed(rows)], "k string, name string, pos bigint, line string")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    a = sha(f"{0:020d}\0{sha('x' + chr(10) + chr(10))}\n{1:020d}\0{sha('y' + chr(10))}\n")
    b = sha(f"{2:020d}\0{sha('z' + chr(10))}\n")
    assert content_digests(frame, ["k"], "pos").first()["digest"] == sha(f"a\0{a}\nb\0{b}\n")
    assert content_digests(frame.limit(0), ["k"], "pos").count() == 0


def test_manifest_is_plain_json(spark, tmp_path, market):
    ingest(spark, PLAIN, put_source(tmp_path / "s", source_files({"000858.SZ": 2})), str(market))
    (file,) = (market / "manifest").rglob("part-*.json")
    data = json.loads(file.read_text())
    assert (data["day"], data["quality"]) == (str(PLAIN), "self_consistent")
    assert {s["stream"]: s["n_rows_csv"] for s in data["streams"]} == {"orders": 2, "trades": 2, "xinqing": 2}


def test_order_survives_splits_and_part_files(spark, tmp_path, market, monkeypatch):
    monkeypatch.setattr("tapelake.operators.ingest._BYTES_PER_TASK", 20_000)
    files = source_files({"000858.SZ": 11, "600519.SH": 1200, "601318.SH": 3})
    source = put_source(tmp_path / "s", {k: data.replace(b"\n", b"\r\n") for k, data in files.items()})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        ingest(spark, PLAIN, source, str(market))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(published(market / "orders")) > 1
    store = RawStore(spark, str(market), parse_registry(spark, REGISTRY))
    got = store.read(ReadRequest("orders", (PLAIN,), ("vol",))).ordered().collect()
    assert [(r["symbol"], r["vol"]) for r in got] == [(line[-1], int(line[9])) for line in lines_of(files, ORDERS)]
