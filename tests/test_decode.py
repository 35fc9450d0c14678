"""Text to numbers and times: every edge value, in a projection and inside a scan."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapelake.functions import archive_day, in_windows, is_short_time, strip_edges, to_int64, to_time_ms, with_time_ms
from tapelake.schema import CONTINUOUS_EXCL_AUCTIONS, Window

INTS = [
    ("", None), (" ", None), ("\x00", None), ("\x00\x00", None), ("abc", None), (None, None), ("1.0", 1), ("-1.5e+02", -150),
    ("1.2018e+006", 1201800), ("-1", -1), ("+1", 1), ("0", 0), ("-0", 0), ("00", 0), ("+0", 0), ("1.9", 1), ("-1.9", -1),
    ("18446744073709551615", None), ("2151938037", 2151938037), ("9007199254740992", 2**53), ("9007199254740993", None),
    ("9007199254740994", 2**53 + 2), ("-9007199254740993", None), ("9223372036854775807", None),
    ("9223372036854775808", None), ("-9223372036854775808", -2**63), (" 9007199254740993 ", None), (" 42 ", 42),
    ("　42　", 42), ("\t42\r\n", 42), ("1d", None), ("1f", None), ("1.5D", None), ("NaN", None), ("Infinity", None),
    ("\x001", None), ("1\x00", None), ("1\x7f", None), ("\x7f1", None), ("0x10", None), ("1e400", None), (".5", 0), ("5.", 5),
    (".", None), ("1e", None), ("1_0", None), ("1 0", None), ("-", None), ("١", None), ("000000000000000000007", 7),
]


def test_int64_edges(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(INTS)], "i int, v string")
    got = [r["x"] for r in df.select("i", to_int64("v").alias("x")).sort("i").collect()]
    assert {INTS[i][0]: g for i, g in enumerate(got)} == dict(INTS)


TIMES = [   # text, always, where short times are allowed
    ("93000123", 34_200_123, 34_200_123), ("093000123", 34_200_123, 34_200_123), ("100000040", 36_000_040, 36_000_040),
    ("95959440", 35_999_440, 35_999_440), ("84500", None, 31_500_000), ("093000", None, 34_200_000),
    ("93000", None, 34_200_000), ("+93000123", None, None), ("9300012", None, None), ("093000.12", None, None), ("", None, None),
    (None, None, None), ("0", None, None), ("0000", None, None), ("0930000000", None, None), ("235959999", 86_399_999, 86_399_999),
    ("09300000", None, None), ("240000", None, None), ("096000", None, None), ("093060", None, None),
    ("000000", None, 0), ("235959", None, 86_399_000), ("253000000", None, None), ("096100000", None, None),
    (" \t093000500\r", 34_200_500, 34_200_500), ("\n\n093000000\n\n", 34_200_000, 34_200_000), (" 84500 ", None, 31_500_000),
    ("  084500  ", None, 31_500_000), ("   ", None, None), ("0930a0000", None, None), ("\x0093000123", None, None),
    ("93000123\x00", None, None), ("12:34:567", None, None), ("　093000123", 34_200_123, 34_200_123),
]


@pytest.mark.parametrize("allowed", [False, True])
def test_time_edges(spark, allowed):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TIMES)], "i int, t string")
    want = [w2 if allowed else w1 for _, w1, w2 in TIMES]
    direct = df.select("i", to_time_ms("t", allowed).alias("ms"))
    by_column = df.select("i", to_time_ms("t", (F.col("i") >= 0) & F.lit(allowed)).alias("ms"))
    staged = with_time_ms(df, "t", "ms", F.lit(allowed)).select("i", "ms")
    for got in (direct, by_column, staged):
        assert [r["ms"] for r in got.sort("i").collect()] == want


def test_short_time_detection(spark):
    cases = {"84500": True, "093000": True, " 84500 ": True, "": False, "0930000": False, "93000123": False, None: False,
             "abcde": False, "+93000": False, "12.450": False, "1": False, "  1  ": False, "\t093000\n": True}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", is_short_time("t").alias("s")).collect()} == cases


def test_strip_keeps_everything_but_white_space(spark):
    cases = {" a ": "a", "　a ": "a", "\x00": "\x00", " \x00 ": "\x00", "": "", "a b": "a b", "\x7f": "\x7f", "é": "é", " é ": "é"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", strip_edges("t").alias("s")).collect()} == cases


def test_windows(spark):
    df = spark.createDataFrame([(t,) for t in (None, 0, 34_199_999, 34_200_000, 41_399_999, 41_400_000, 46_800_000, 53_820_000)],
                               "t bigint")
    got = [r["t"] for r in df.filter(in_windows("t", CONTINUOUS_EXCL_AUCTIONS)).collect()]
    assert got == [34_200_000, 41_399_999, 46_800_000]
    assert df.filter(in_windows("t", ())).count() == 0
    for bad in ((-1, 5), (5, 5), (0, 86_400_001)):
        with pytest.raises(ValueError):
            Window(*bad)


def test_archive_names(spark):
    good, bad = "20220104.7z", ("20220104(1).7z", "20220104.7z.downloading", "2022-01-04.7z", "20221301.7z", "notes.txt", "")
    df = spark.createDataFrame([(n,) for n in (good, *bad)], "n string")
    got = {r["n"]: r["d"] for r in df.select("n", archive_day("n").alias("d")).collect()}
    assert f"{got.pop(good):%Y%m%d}" == "20220104" and set(got.values()) == {None}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.integers(-2**64, 2**64).map(str), st.floats(allow_nan=False, allow_infinity=False).map(repr),
                          st.text("0123456789+-.eE \t\x00", max_size=12)), min_size=20, max_size=60))
def test_int64_follows_the_rule_on_random_text(spark, values):
    import re
    number = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", re.ASCII)

    def want(text):
        t = text.strip(" \t")
        if not number.fullmatch(t):
            return None
        d = float(t)
        if not -2.0**63 <= d < 2.0**63:
            return None
        return None if re.fullmatch(r"[+-]?\d+", t) and -2**63 <= int(t) < 2**63 and int(d) != int(t) else int(d)

    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = [r["x"] for r in df.select("i", to_int64("v").alias("x")).sort("i").collect()]
    assert got == [want(v) for v in values]
