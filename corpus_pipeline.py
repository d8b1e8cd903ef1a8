"""A corpus pipeline of five stages over the documents table.

Each stage reads the columns of documents (others are dropped) and works on all rows that it is given. Nulls and edges: a null
text, or one without a letter, goes with the first stage; a null lang never trains and a null source or lang is a value of its own
for the mixing; null, repeated and shared doc_ids are told apart by content (equal rows of id and text are one group of the second
stage, so one stays); empty and very long texts are whole documents; ties end with doc_id or a hash of the row; an empty table
passes through all stages; where no document has a lang, the first stage rejects all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexlane.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from hexlane.llm.common import fresh_path, row_id, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_KEYS = 500_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models don't reject; trained on all that have a lang."""
    keyed = docs.withColumn("rk", row_id("doc_id", "text"))
    gone = written(language_id.identify(keyed, docs, ["rk"]).where("rejected").select("rk").distinct(), "rejected")
    return keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, "rk", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets similar by 0.8: that of the least doc_id, nulls last."""
    # rows are compared by content, for an id may be null, repeated, or shared by different texts
    keyed = docs.select(*COLUMNS, row_id("doc_id", "text").alias("rk"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rk")
    groups = written(jaccard_join.join_sets(keyed.select(place.alias("doc_id"), "text"), k=5, num=80, den=100), "row-groups")
    gone = written(groups.where("doc_id <> component_id").select("doc_id.rk").distinct(), "near-duplicates")
    equal = written(groups.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id.rk").count().where("count > 1").select("rk"), "equal-rows")
    kept = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, "rk", "left_anti")
    if not equal.take(1):
        return kept.select(*COLUMNS)
    # rows of one id and text differ in other columns at most: the least stays
    equal = F.broadcast(equal) if equal.count() <= BROADCAST_KEYS else equal
    one = kept.join(equal, "rk", "left_semi").groupBy("rk").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row")).select("row.*")
    return kept.join(equal, "rk", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    gone = written(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("rk").distinct(), "leaks")
    kept = docs.withColumn("rk", row_id("doc_id", "text"))
    return kept.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, "rk", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn for the target weights."""
    return mixing.sample(docs).where("kept").select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    placed = sharding.assign(docs).select("doc_id", "size", "text_crc32", "shard")
    return placed


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        path = fresh_path(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
