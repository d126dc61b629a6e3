"""The corpus pipeline: quality rules, near-duplicates, repeated passages, live credentials, packing.

Each stage takes all documents that the one before kept and returns the columns
of ``documents``; the last returns the packed pieces. Rows are never capped. A
text that changes gets its ``n_chars`` anew; a document whose text is removed
whole stays with an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silolens.llm import credentials, decision_rules, lpf, packing, simhash
from silolens.llm.common import stored, table
from silolens.session import ship_package


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the list learned from the labels of those at hand."""
    ship_package(spark)
    rules = decision_rules.fit(docs, table(spark, sf_dir, "labels"))
    return decision_rules.keep_good(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that with the smallest id."""
    ship_package(spark)
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that also start earlier."""
    ship_package(spark)
    return _counted(lpf.dedup(docs, as_text=True))


def live_credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the credentials of single owners masked."""
    ship_package(spark)
    return _counted(credentials.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every id of every document in one piece of one sequence."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("live_credentials", live_credentials),
    ("packed", packed),
]

#: Tokenisation and learned rules cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
