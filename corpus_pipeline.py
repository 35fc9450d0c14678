"""A training corpus from raw documents, in stages that each write their result for the next.

A stage's result must be written before the next stage is called, which removes the scratch tables of the stage before. Tables that
operators store outside the pipeline are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tapelake.llm import ngram_join, phrase_index, quality_divergence, shuffle_matrix, source_mix
from tapelake.llm.store import numbered, release, scratch, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the stage called last.
_TABLES: list[str] = []


def _staged(work: Stage) -> Stage:
    """The stage, noting its scratch tables after those of the stage before are gone."""
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _TABLES)
        with scratch(_TABLES):
            return work(spark, docs, sf_dir)

    return stage


@_staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and do not diverge from their language."""
    rows, restored = numbered(docs, "lang", "text")
    own = [c for c in rows.columns if c.startswith("_column")]
    return restored(quality_divergence.judged(rows, own).filter("kept"))


@_staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar ones."""
    return ngram_join.representatives(docs)


@_staged
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return phrase_index.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_staged
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return source_mix.mixed_documents(docs)


@_staged
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and place there; columns of these names become ``input_shard`` and ``input_slot``."""
    return shuffle_matrix.shuffled(docs, 24, docs.columns)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: Similarity groups and random draws are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table on."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        before, written = written, []
        result = stage(spark, docs, sf_dir)
        with scratch(written):
            docs = stored(result, "pipeline-" + name.replace(" ", "-"))
        release(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
