"""Circles among many entries are told as soon as nothing but circles is left."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tapelake.operators.registry_rules import chain_problems


def test_rounds_go_by_the_longest_chain(spark, monkeypatch):
    # Entry 0 is live; 1 and 2 point at each other, 3 to 9 at themselves, the others at half their number.
    n = F.col("id")
    to = F.when(n == 0, None).when(n == 1, 2).when(n == 2, 1).when(n < 10, n).when(n % 3 == 0, 0).otherwise(F.floor(n / 2))
    rows = spark.range(4000).select(n.cast("string").alias("id"), F.when(n == 0, "active").otherwise("superseded").alias("status"),
                                    to.cast("string").alias("superseded_by"))
    calls, checkpoint = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a: calls.append(1) or checkpoint(self, *a))
    got = {r["id"]: r["problem"] for r in chain_problems(rows).collect()}
    want = {}
    for k in range(1, 4000):
        at = k
        while at >= 10:
            at = 0 if at % 3 == 0 else at // 2
        if at:
            want[str(k)] = "supersede chain circles"
    assert got == want
    # ten hops at most: four doublings and a round that finds nothing new
    assert len(calls) <= 3 + 4 * 6
