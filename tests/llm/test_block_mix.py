"""The mix in whole documents follows the blocks that the slots take."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

from tapelake.llm import source_mix


def test_copies_follow_the_taken_blocks(spark, monkeypatch):
    # Every document is one block; of every four blocks three are taken, each of them twice, which is the target.
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"),
                                   F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), "id"), source_mix.BLOCK)).alias("text"))

    def slots(sources):
        blocks = sources.select("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(399).cast("long"))).alias("_block"))
        return blocks.filter("_block % 4 > 0").select(F.lit(0).alias("_shard"), "_s", F.explode(F.array(F.lit(0), F.lit(1))).alias("_slot"), "_block")

    monkeypatch.setattr(source_mix, "slots", slots)
    # of so few documents each would be a large one
    for large in (1024, 8):
        monkeypatch.setattr(source_mix.copied, "__defaults__", (4, large, source_mix.PASSES))
        got = collections.Counter(r.doc_id for r in source_mix.mixed_documents(docs).select("doc_id").collect())
        assert len(got) == 300 and set(got.values()) == {2}


def test_fitted_shares_meet_the_target():
    size, taken = [5, 10, 20], [10, 5, 0]
    for target in (0.0, 7.0, 15.0, 40.0, 70.0):
        shares = [source_mix._fitted(t / s, target, sum(taken), sum(size)) for s, t in zip(size, taken)]
        assert all(0 <= x <= 2 for x in shares)
        assert abs(sum(x * s for x, s in zip(shares, size)) - target) < 1e-9
