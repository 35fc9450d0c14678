"""Uniform shuffling into shards of exact sizes by a hypergeometric communication matrix, in DataFrame functions only.

Rows are dealt into source partitions by a hash. How many rows of each partition go to each shard is drawn first, as a
matrix with exact margins: every entry is a hypergeometric draw given all entries before it. Each partition is then permuted
and cut by its row of the matrix, and each shard is permuted again. Which rows land in a shard is thus uniform over all
assignments with these shard sizes, which differ by one row at most, and no task ever sorts a whole shard.

The matrix is drawn in two levels, groups of partitions first, so that its work is spread and every array stays at the
square root of the number of partitions. Null ids and texts are hashed like any other value; identical rows are told apart
by order only, which changes nothing in the result; an empty table gives no rows; other columns ride along unchanged, those
named ``shard`` or ``slot`` as ``input_shard`` and ``input_slot``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelake.llm.store import numbered, renamed_apart, stored

PARTITION_ROWS = 1000


def _let(value: Column, body) -> Column:
    """The body for a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(first: Column, last: Column, down: bool = False) -> Column:
    some = first >= last if down else first <= last
    return F.when(some, F.sequence(first, last, F.lit(-1 if down else 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(good: Column, total: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``draws`` rows out of ``total`` come from the ``good`` ones, for a uniform number in [0, 1).

    Inversion from the mode outwards, with weights relative to the mode's, over ten standard deviations to each side.
    """
    one, real = F.lit(1).cast("long"), lambda c: c.cast("double")

    def ends(v: Column) -> Column:
        mode = F.floor(real(v["n"] + 1) * real(v["k"] + 1) / real(v["t"] + 2)).cast("long")
        low, high = F.greatest(F.lit(0).cast("long"), v["n"] - v["t"] + v["k"]), F.least(v["n"], v["k"])
        part = real(v["k"]) / F.greatest(real(v["t"]), F.lit(1.0))
        spread = F.sqrt(F.greatest(real(v["n"]) * part * (1 - part), F.lit(0.0)))
        wide = F.ceil(spread * 10 + 20).cast("long")
        return F.struct(v["n"].alias("n"), v["k"].alias("k"), (v["t"] - v["k"] - v["n"]).alias("b"), uniform.alias("u"),
                        F.least(F.greatest(mode, low), high).alias("m"), low.alias("low"), high.alias("high"), wide.alias("w"))

    def ranges(v: Column) -> Column:
        up, down = _steps(v["m"] + one, F.least(v["high"], v["m"] + v["w"])), _steps(v["m"] - one, F.greatest(v["low"], v["m"] - v["w"]), True)
        return F.struct(*[v[c].alias(c) for c in ("n", "k", "b", "u", "m")], up.alias("up"), down.alias("down"))

    def rise(v: Column, i: Column) -> Column:
        return real(v["k"] - i + 1) * real(v["n"] - i + 1) / (real(i) * real(v["b"] + i))

    def fall(v: Column, i: Column) -> Column:
        return real(i + 1) * real(v["b"] + i + 1) / (real(v["k"] - i) * real(v["n"] - i))

    def weight(v: Column, side: str, ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("s"))
        return F.aggregate(v[side], start, lambda s, i: _let(s["p"] * ratio(v, i), lambda p: F.struct(p.alias("p"), (s["s"] + p).alias("s"))),
                           lambda s: s["s"])

    def walk(v: Column, side: str, ratio, rest: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("p"), rest.alias("r"), v["m"].alias("x"))
        # The place moves on as long as something of the target weight is left.
        return F.aggregate(v[side], start, lambda s, i: F.when(s["r"] < 0, s).otherwise(_let(
            s["p"] * ratio(v, i), lambda p: F.struct(p.alias("p"), (s["r"] - p).alias("r"), i.alias("x")))), lambda s: s["x"])

    def chosen(v: Column) -> Column:
        def by(w: Column) -> Column:
            target = v["u"] * (1 + w["up"] + w["down"])
            return F.when(target < 1, v["m"]).when(target < 1 + w["up"], walk(v, "up", rise, target - 1)).otherwise(
                walk(v, "down", fall, target - 1 - w["up"]))
        return _let(F.struct(weight(v, "up", rise).alias("up"), weight(v, "down", fall).alias("down")), by)

    given = F.struct(good.cast("long").alias("k"), total.cast("long").alias("t"), draws.cast("long").alias("n"))
    return _let(given, lambda g: _let(ends(g), lambda e: _let(ranges(e), chosen)))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def matrix(sums: Column, capacities: Column, seed: Column) -> Column:
    """Rows with the given sums whose columns add up to the capacities, drawn as if all rows were dealt out at random."""
    none = F.array().cast("array<bigint>")

    def row(left: Column, n: Column, at: Column) -> Column:
        start = F.struct(n.alias("n"), F.aggregate(left, F.lit(0).cast("long"), lambda s, x: s + x).alias("t"), none.alias("xs"))

        def cell(s: Column, c: Column) -> Column:
            x = hypergeometric(c, s["t"], s["n"], _uniform(seed, at, F.size(s["xs"])))
            return _let(x, lambda v: F.struct((s["n"] - v).alias("n"), (s["t"] - c).alias("t"), F.concat(s["xs"], F.array(v)).alias("xs")))
        return F.aggregate(left, start, cell, lambda s: s["xs"])

    start = F.struct(capacities.alias("left"), F.array().cast("array<array<bigint>>").alias("rows"))
    return F.aggregate(sums, start, lambda s, n: _let(row(s["left"], n, F.size(s["rows"])), lambda xs: F.struct(
        F.zip_with(s["left"], xs, lambda a, b: a - b).alias("left"), F.concat(s["rows"], F.array(xs)).alias("rows"))), lambda s: s["rows"])


def _drawn(counts: DataFrame, side: int, n_shards: int, rows: int, seed: int) -> DataFrame:
    """For each partition (_g, _q) the running totals of its row of the matrix."""
    groups = stored(counts.groupBy("_g").agg(F.sum("_n").alias("_all"), F.sort_array(F.collect_list(F.struct("_q", "_n"))).alias("_qs")), "shuffle-counts")
    shares = F.array(*[F.lit(rows // n_shards + (k < rows % n_shards)).cast("long") for k in range(n_shards)])
    # One row with the sums of the groups, about the square root of the number of partitions.
    whole = groups.agg(F.sort_array(F.collect_list(F.struct("_g", "_all"))).alias("_gs"))
    tops = whole.select("_gs", matrix(F.col("_gs._all"), shares, F.lit(seed)).alias("_m")).select(
        F.explode(F.arrays_zip("_gs", "_m")).alias("_z")).select("_z._gs._g", F.col("_z._m").alias("_share"))
    cells = groups.repartition(side, "_g").join(tops, "_g").select("_g", "_qs", matrix(F.col("_qs._n"), F.col("_share"), F.xxhash64(F.lit(seed), "_g")).alias("_m"))
    each = cells.select("_g", F.explode(F.arrays_zip("_qs", "_m")).alias("_z")).select("_g", F.col("_z._qs._q").alias("_q"), F.col("_z._m").alias("_xs"))
    ends = F.transform("_xs", lambda x, i: F.aggregate(F.slice("_xs", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, y: s + y))
    return each.select("_g", "_q", ends.alias("_ends"))


def shuffled(df: DataFrame, n_shards: int, key: Sequence[str], seed: int = 20, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """The rows of ``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``key`` names the columns that tell rows apart. ``partition_rows`` is about how many rows a source partition has.
    """
    columns = df.columns
    df = renamed_apart(df, ["shard", "slot"])
    renamed = dict(zip(columns, df.columns))
    inner, _ = numbered(df)
    places = {c: f"_column{i}" for i, c in enumerate(df.columns)}
    hashed = inner.withColumn("_h", F.xxhash64(F.lit(seed), *[places[renamed[k]] for k in key]))
    rows = hashed.count()
    side = max(2, math.isqrt(rows // partition_rows) + 1)
    spread = lambda n, bits: F.pmod(F.shiftrightunsigned("_h", bits), F.lit(n)).cast("int")
    placed = hashed.withColumn("_g", spread(side, 32)).withColumn("_q", spread(side, 3))
    counts = placed.groupBy("_g", "_q").agg(F.count(F.lit(1)).alias("_n"))
    ends = stored(_drawn(counts, side, n_shards, rows, seed), "shuffle-matrix")
    local = F.row_number().over(Window.partitionBy("_g", "_q").orderBy(F.xxhash64("_h", F.lit(1)), "_h")) - 1
    sent = placed.withColumn("_r", local).join(ends, ["_g", "_q"]).withColumn(
        "shard", F.size(F.filter("_ends", lambda e: e <= F.col("_r"))).cast("int"))
    sent = sent.drop("_g", "_q", "_r", "_ends")
    # A shard's second permutation is an order by another hash, sorted in ranges of that hash.
    pieces = max(1, rows // n_shards // partition_rows)
    sent = sent.withColumn("_p", F.xxhash64("_h", F.lit(2))).withColumn(
        "_b", F.shiftright(F.shiftrightunsigned("_p", 33) * pieces, 31).cast("int"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.select("shard", "_b").groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_from"))
    inner = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_p", "_h"))
    out = sent.withColumn("_i", inner).join(starts, ["shard", "_b"])
    out = out.withColumn("slot", (F.col("_from") + F.col("_i") - 1).cast("long"))
    return out.select(*[F.col(n).alias(c) for c, n in places.items()], "shard", "slot")
