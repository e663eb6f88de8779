"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir), returns a DataFrame, and reads what the one before wrote.

A document leaves in ``language`` if its text has no letter or its language
cannot be told (best probability under ``LEAST_SCORE``), in ``near_dedup`` if a
document with a smaller doc_id is in its group of near-duplicates, in
``decontamination`` if it holds a window of a benchmark item, and in ``mixing`` if
it is not drawn. A null lang is filled with the predicted one. The last stage
writes token ids and returns what it reads back.

Nulls, repeated rows, empty tables and further columns: as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm import decontaminate, langid, mixture, simhash, tokenfile
from plexgraph.llm.common import packed, stored, table, unpacked

LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = langid.predict(packed(docs, "lang", "text"), langid.fit(docs))
    kept = told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return unpacked(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), docs.columns, "lang", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(packed(docs, "text"), table(spark, sf_dir, "benchmark"), keep=("own", "text"))
    return unpacked(found.filter(F.size("spans") == 0), docs.columns, "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token-ID output", token_output),
]

#: SQL expresses neither the network nor XXH64.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
