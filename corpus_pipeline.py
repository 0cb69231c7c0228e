"""Five stages from raw documents to batches for training.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``. Stages know nothing of each other: each works on all rows that it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewave.deploy import ship
from tidewave.llm import decontamination, langid, packing, setsketch, suffix_dedup
from tidewave.llm.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, those in no language learned and those whose language is all but a guess."""
    return langid.keep_known(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a similarity of 0.8 of five-word shingles stays."""
    return setsketch.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 200 bytes that occurred before out of the texts: the first of equal ones stays."""
    return suffix_dedup.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that hold a passage of a test item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and batches."""
    return packing.length_buckets(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL has no language model, sketches or alignment; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
