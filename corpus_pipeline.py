"""The training corpus: toxicity, near-dedup, benchmark decontamination, mixing and sharding of `documents`, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ethospark.llm import decontaminate, mixing, neardup, sharding, toxicity
from ethospark.llm.common import materialize, remove_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or toxicity is below the threshold; null and empty texts are scored as they are, and other columns, whatever their names, stay."""
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the least doc_id, and one row of those with its id; rows without id or text stay."""
    return neardup.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; rows without text stay."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document's row once for each epoch that takes it, and a document without words once."""
    return mixing.mixed_documents(docs, _table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of each row of the mix; rows of a document that comes twice have places of their own."""
    return sharding.interleave(docs)


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", shard)]

#: Training, signatures and alignment are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; an empty table gives no rows. A stage's table goes when the next one is written."""
    docs = last = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, last, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            remove_table(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
