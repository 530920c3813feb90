"""A training corpus from ``documents``: toxic ones go, one of each group of near duplicates stays, repeated
passages and benchmark items go, and the sources are mixed to equal weights.

Each stage takes what the one before kept, written as Parquet and read again.
All stages but the last return the columns of their input; the last adds ``repetition``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveloom.llm import decontaminate, mixing, simhash, substrings, toxicity
from sieveloom.llm.common import drop_stash, drop_stashes, stash, stash_mark, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express a trained classifier, nor the latent search; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = stash_mark()
        made = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return made
        made = stash(made)
        # what the stage was made from is read by nothing now
        drop_stashes(spark, mark, made)
        drop_stash(docs)
        docs = made
    return docs
