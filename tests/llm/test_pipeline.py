"""The stages of the corpus pipeline, each against what it must do to its input."""

from __future__ import annotations

import collections
import os

from pyspark.sql import functions as F

import corpus_pipeline
from tapelake.llm import ngram_join, phrase_index, quality_divergence
from tapelake.llm.store import stored

SF = "/root/testdata/sf0.001"


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage", keep=True)
        at.append(docs)
        if name != "sharding":
            assert docs.columns == columns
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    assert ids(at[0]) == ids(quality_divergence.judged(whole, ["doc_id"]).filter("kept"))
    groups = collections.defaultdict(set)
    for r in ngram_join.similar_documents(at[0]).collect():
        groups[r.component_id].add(r.doc_id)
    assert ids(at[1]) == collections.Counter(min(x) for x in groups.values())
    hits = phrase_index.contamination(at[1], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(at[2]) == ids(hits.filter("not contaminated"))
    assert set(ids(at[3])) <= set(ids(at[2])) and max(ids(at[3]).values()) <= 2
    assert ids(at[4]) == ids(at[3])
    sizes = [r["count"] for r in at[4].groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_stages_on_odd_rows(spark, odd, none):
    clash = ["Shard", "slot", "_row", "_text_id", "kept", "row", "_column0", "_set"]
    for docs in (odd, none):
        docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in clash})
        docs = stored(docs.drop("shard").withColumn("Shard", F.lit("mine")), "test-odd", keep=True)
        given = collections.Counter(docs.collect())
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "sharding":
                assert sorted(out.columns) == sorted([c for c in docs.columns if c not in ("Shard", "slot")] + ["input_Shard", "input_slot", "shard", "slot"])
                back = out.select(*[F.col({"Shard": "input_Shard", "slot": "input_slot"}.get(c, c)).alias(c) for c in docs.columns])
                assert collections.Counter(back.collect()) == given
                assert sorted(r.slot for r in out.filter("shard = 0").collect()) == list(range(out.filter("shard = 0").count()))
            else:
                assert out.columns == docs.columns
                kept = collections.Counter(out.collect())
                assert all(n <= given[r] * 2 for r, n in kept.items())


def test_results_outside_survive_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lazy = ngram_join.similar_documents(docs)
    corpus_pipeline.run(spark, SF).count()
    assert lazy.count() == docs.count()


def test_stages_release_their_tables(spark, odd):
    docs = stored(odd.select("doc_id", "text", "lang", "source", "n_chars"), "test-odd", keep=True)
    corpus_pipeline.quality(spark, docs, SF).collect()
    before = list(corpus_pipeline._TABLES)
    corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert before and not any(os.path.exists(p.removeprefix("file:")) for p in before)
    assert all(os.path.exists(p.removeprefix("file:")) for p in corpus_pipeline._TABLES)
