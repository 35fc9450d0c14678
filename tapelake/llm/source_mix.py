"""Mixing sources to target weights in blocks of tokens.

Every source's documents, in a fixed order, are one stream of words cut into blocks of equal length. A source's target in
words becomes a number of slots, one block each. The slots of all sources are spread over output shards: each source's slots
are drawn multinomially over the shards, so a shard's source counts are multinomial given the totals of the mix, and the mix
as a whole meets every target. Slots number the source's blocks through a keyed permutation of the block numbers, a new one
for every pass; as a target is at most twice its source, no block is taken a third time. Slots and documents meet in a join by
source and block. That is the mix in words; the mix in whole documents takes the same slots: the words that its blocks take of a
document are its share, and shares are rounded to whole copies so that the roundings of a source cancel out.

Draws, order and permutations depend on the rows and the seed alone, so reruns agree. Null texts have no words and are never
taken; null sources are a source of their own, the last; ids may be null or repeat, identical rows being interchangeable; an
empty table gives an empty mix; all other columns ride along, those added here beginning with an underscore. The place of a
document in its source's stream comes from two levels of running sums over about the square root of the rows, so that no task
sorts a whole source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelake.llm.store import numbered, stored
from tapelake.llm.words import mixed

BLOCK, SHARD_SLOTS = 64, 1 << 16
#: Weights of the sources in the order of their names, repeating; words in the mix per word of input; passes over a source.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Whole documents of at least one part in LARGE of their source are dealt one by one.
LARGE = 1024
#: Parts of a whole copy in which shares of documents are summed.
_ONE = 1 << 30


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, "[ \\t-\\r]+"), "")), F.lit(0)).cast("long")


def placed(docs: DataFrame, text: str = "text", source: str = "source", key: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """The rows without text, with _size, _s (number of the source) and _from (place in its stream); the sources with targets."""
    sized = docs.withColumn("_size", F.when(F.col(text).isNull(), 0).otherwise(n_words(F.col(text))).cast("long"))
    sized = stored(sized.withColumn("_t", F.xxhash64(text)).drop(text), "mix-rows")
    side = math.isqrt(sized.count()) + 1
    sources = targets(sized.groupBy(F.col(source).alias("_source")).agg(F.sum("_size").alias("_source_size")))
    sources = stored(sources, "mix-sources")
    rows = sized.join(sources.select("_source", "_s"), F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*key, "_size", "_t"), F.lit(side)).cast("int"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_s", "_b").agg(F.sum("_size").alias("_n")).select(
        "_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_s", "_b").orderBy(*key, "_size", "_t").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum("_size").over(inner), F.lit(0))).join(starts, ["_s", "_b"])
    return out.withColumn("_from", F.col("_start") + F.col("_in")).drop("_b", "_t", "_in", "_start"), sources


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Sources with number, weight and target: shares by weight, filled up to the cap of each source.

    Filling goes by the ratio of cap to weight: a source is full if, with all sources before it full, the rest would give it
    more than its cap. One window over the sources, which are few beside the rows.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    rows = sizes.withColumn("_s", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("_w", F.get(F.array(*map(F.lit, weights)), F.col("_s") % len(weights)).cast("double"))
    rows = rows.withColumn("_cap", (F.col("_source_size") * passes).cast("double"))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), "_s")
    before, every = filling.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("_source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = rest / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", level).withColumn("_full", F.col("_cap") / F.col("_w") <= F.col("_level"))
    final = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), F.col("_s"), F.col("_level"))))
    final = final.over(every)["_level"]
    return rows.withColumn("_target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * final)).drop("_cap", "_level", "_full")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each index goes in a keyed permutation of the numbers below its size: a Feistel network, walked into range."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask, key = (np.uint64(1) << half) - np.uint64(1), mixed(key.astype(np.uint64))
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mixed(right * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def slots(sources: DataFrame, seed: int = 4, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: one row a slot with _shard, _s, _slot and the _block it takes."""
    blocks = F.ceil(F.col("_source_size") / block).cast("long")
    quota = F.round(F.col("_target") * blocks / F.col("_source_size")).cast("long")
    wanted = sources.filter(F.col("_source_size") > 0).select("_s", blocks.alias("_blocks"), quota.alias("_quota"))
    shards = wanted.agg(F.greatest(F.ceil(F.sum("_quota") / shard_slots), F.lit(1)).cast("long").alias("_shards"))

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s, n_blocks, n, n_shards in frame.itertuples(index=False):
                counts = np.random.default_rng([seed, int(s)]).multinomial(n, np.full(n_shards, 1 / n_shards))
                yield pd.DataFrame({"_shard": np.arange(n_shards), "_s": s, "_blocks": n_blocks, "_count": counts,
                                    "_first": np.cumsum(counts) - counts})

    @F.pandas_udf("long")
    def block_of(s: pd.Series, at: pd.Series, size: pd.Series) -> pd.Series:
        n = size.to_numpy(np.int64)
        again = at.to_numpy(np.int64) // n
        keys = np.uint64(seed) + s.to_numpy(np.uint64) * np.uint64(1 << 20) + again.astype(np.uint64)
        return pd.Series(permuted(at.to_numpy(np.int64) - again * n, n, keys))

    # One row: the number of shards.
    counts = wanted.join(F.broadcast(shards)).select("_s", "_blocks", "_quota", "_shards").mapInPandas(
        drawn, "_shard bigint, _s int, _blocks bigint, _count bigint, _first bigint")
    # Dealt out before they are unfolded: a source's shards come out of one task.
    spread = stored(counts.filter(F.col("_count") > 0), "mix-counts").repartition("_shard", "_s")
    each = spread.select("_shard", "_s", "_blocks", F.explode(F.sequence("_first", F.col("_first") + F.col("_count") - 1)).alias("_slot"))
    return each.select("_shard", "_s", "_slot", block_of("_s", "_slot", "_blocks").alias("_block"))


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_s, _block, _from, _words): the part of every document in every block it reaches into."""
    own = rows.filter(F.col("_size") > 0).select("_s", "_from", (F.col("_from") + F.col("_size")).alias("_to"))
    each = own.select("*", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))).alias("_block"))
    words = F.least("_to", (F.col("_block") + 1) * block) - F.greatest("_from", F.col("_block") * block)
    return each.select("_s", "_block", "_from", words.alias("_words"))


def _takes(sources: DataFrame) -> DataFrame:
    """How often each block is taken. Unfolded ranges look small to the planner, which must not broadcast them."""
    return slots(sources).groupBy("_s", "_block").agg(F.count(F.lit(1)).cast("int").alias("_takes")).hint("merge")


def taken_words(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Placed rows with _taken, the words of them in the blocks that the slots take, repeats counted."""
    taken = pieces(rows).join(_takes(sources), ["_s", "_block"]).groupBy("_s", "_from").agg(F.sum(F.col("_words") * F.col("_takes")).alias("_taken"))
    taken = taken.select(F.col("_s").alias("_ts"), F.col("_from").alias("_tf"), "_taken").hint("merge")
    # An empty document shares its place with the next one and gets nothing.
    at = (F.col("_s") == F.col("_ts")) & (F.col("_from") == F.col("_tf")) & (F.col("_size") > 0)
    return rows.join(taken, at, "left").drop("_ts", "_tf").withColumn("_taken", F.coalesce("_taken", F.lit(0)))


def mixed_words(docs: DataFrame) -> DataFrame:
    """The rows with _size, source columns and _taken, the words of them in the mix, repeats counted."""
    rows, sources = placed(docs.select("doc_id", "source", "text"))
    out = taken_words(stored(rows, "mix-placed"), sources)
    return out.join(sources.select("_s", "_source_size", "_target"), "_s")


def _fitted(share: float, target: float, taken: float, total: float, passes: int = PASSES) -> float:
    """A share of 0 to ``passes`` copies, moved so that documents of ``total`` words, ``taken`` by their shares, come to ``target``."""
    if target <= taken:
        return share * target / max(taken, 1.0)
    return passes - (passes - share) * (passes * total - target) / (passes * total - taken)


def _dealt(size: list[int], n: list[int], share: list[float], target: float, taken: float, total: float, seed: list[int],
           passes: int = PASSES) -> list[int]:
    """Copies of a source's large documents, given largest first: as many of each as leave a target that the rest can meet.

    Where both numbers next to its fitted share do, one is drawn; where none does, the miss is at most half the document, and the
    smaller one is chosen.
    """
    rng, out = np.random.default_rng(seed), []
    for words, rows, own in zip(size, n, share):
        copies = 0
        for _ in range(rows):
            after, ratio = total - words, _fitted(own, target, taken, total, passes)
            low = min(math.floor(ratio), passes)
            misses = {c: max(c * words - target, target - c * words - passes * after, 0.0) for c in (low, low + 1) if c <= passes}
            best = [c for c, miss in misses.items() if miss == min(misses.values())]
            took = best[-1] if len(best) == 1 or rng.random() < ratio - low else best[0]
            copies, total, taken = copies + took, after, max(taken - own * words, 0.0)
            target = min(max(target - took * words, 0.0), passes * total)
        out.append(copies)
    return out


def copied(keyed: DataFrame, seed: int = 4, large: int = LARGE, passes: int = PASSES) -> DataFrame:
    """(_row, _rows, _copies) of all rows with words: how many rows have the same hash and how many are in the mix.

    A document's share is the number of its words in the blocks that the slots take, over its size; here shares become whole copies.
    Documents with at least one part in ``large`` of their source's words, at most that many a source, are dealt one by one.
    The others, fitted to what is left of the target, are rounded by systematic sampling in the order of their sizes: sums of copies
    differ from sums of shares by less than one at every place, so sums of words do by less than the first and largest of them.
    """
    rows, sources = placed(keyed.select("_row", "source", "text"), key=("_row",))
    drawn = taken_words(stored(rows, "mix-placed"), sources).filter(F.col("_size") > 0).groupBy("_s", "_row", "_size").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_taken").alias("_taken"))
    drawn = stored(drawn.join(sources.select("_s", "_source_size", "_target"), "_s"), "mix-drawn")
    words = F.col("_size") * F.col("_rows")
    is_large = F.col("_size") * large >= F.col("_source_size")
    of_all = drawn.groupBy("_s", "_target").agg(F.sum(words).alias("_total"), F.sum("_taken").alias("_all_taken"))

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_size", "_row"], ascending=[False, True])
        s, target, total, taken = frame[["_s", "_target", "_total", "_all_taken"]].iloc[0]
        share = frame["_taken"] / (frame["_size"] * frame["_rows"])
        copies = _dealt(frame["_size"].tolist(), frame["_rows"].tolist(), share.tolist(), float(target), float(taken), float(total),
                        [seed, int(s)], passes)
        return frame[["_s", "_row", "_size", "_rows", "_taken"]].assign(_copies=copies)

    first = drawn.filter(is_large).join(of_all.drop("_target"), "_s").groupBy("_s").applyInPandas(
        deal, "_s int, _row bigint, _size bigint, _rows bigint, _taken bigint, _copies bigint")
    first = stored(first, "mix-large")
    spent = first.groupBy("_s").agg(F.sum(words).alias("_large"), F.sum(F.col("_size") * F.col("_copies")).alias("_spent"),
                                    F.sum("_taken").alias("_large_taken"))
    left = of_all.join(spent, "_s", "left").na.fill(0, ["_large", "_spent", "_large_taken"])
    total, taken = F.col("_total") - F.col("_large"), F.col("_all_taken") - F.col("_large_taken")
    target = F.least(F.greatest(F.col("_target") - F.col("_spent"), F.lit(0.0)), total * passes)
    draw = F.pmod(F.xxhash64(F.lit(seed), "_s"), F.lit(_ONE))
    left = left.select("_s", target.alias("_left"), taken.alias("_left_taken"), total.alias("_left_total"), draw.alias("_draw"))
    # Ranks: places in range partitions sorted by size, after the rows of the partitions before. Shares are whole numbers of small
    # parts, whose sums do not depend on where partitions begin.
    own = F.col("_taken") / words
    more = passes - (passes - own) * F.try_divide(passes * F.col("_left_total") - F.col("_left"), passes * F.col("_left_total") - F.col("_left_taken"))
    fitted = F.when(F.col("_left") <= F.col("_left_taken"), own * F.col("_left") / F.greatest("_left_taken", F.lit(1))).otherwise(more)
    share = F.least(F.greatest(F.round(fitted * _ONE).cast("long"), F.lit(0)), F.lit(passes * _ONE)) * F.col("_rows")
    order = [F.col("_s"), F.col("_size").desc(), F.xxhash64(F.lit(seed), "_row"), F.col("_row")]
    small = drawn.filter(~is_large).join(left, "_s").select("_s", "_row", "_size", "_rows", share.alias("_share"), "_draw")
    small = small.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    small = stored(small.withColumn("_at", F.monotonically_increasing_id()), "mix-order")
    before = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = small.groupBy("_s", "_part").agg(F.sum("_share").alias("_n")).select(
        "_s", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_s", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = small.withColumn("_in", F.coalesce(F.sum("_share").over(inner), F.lit(0))).join(starts, ["_s", "_part"])
    up_to = lambda shares: F.call_function("div", shares + F.col("_draw"), F.lit(_ONE))
    at = F.col("_start") + F.col("_in")
    ranked = ranked.withColumn("_copies", up_to(at + F.col("_share")) - up_to(at))
    return first.select("_row", "_rows", "_copies").unionByName(ranked.select("_row", "_rows", "_copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix in whole documents: each row is repeated 0 to PASSES times, as the blocks that the slots take share it out, and
    every source's words meet its target.

    Texts stay out of the work on the mix and move once, to meet their number of copies by a hash of the whole row; identical
    rows share the copies of all of them.
    """
    inner, restored = numbered(docs, "source", "text")
    keyed = inner.withColumn("_row", F.xxhash64(*[c for c in inner.columns if c.startswith("_column")]))
    copies = copied(keyed.select("_row", "source", "text"))
    out = keyed.join(stored(copies.filter(F.col("_copies") > 0), "mix-copies"), "_row")
    rank = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    each = F.floor(F.col("_copies") / F.col("_rows")) + (rank <= F.col("_copies") % F.col("_rows")).cast("long")
    return restored(out.withColumn("_each", each).filter(F.col("_each") > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_each"))))
