"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import decontaminate, mix, near_dup, quality, shard
from pairlab.llm.base import table, word_count, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: near-duplicates share so many hundredths of their shingles; op5 alone has 85
NEAR_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy of the rule ledger keeps.

    A null or empty text fails the rules and goes; equal rows are judged alike and
    each kept or dropped; null ids, languages and sources do not matter; an empty
    table stays empty; columns besides those of documents are not passed on.
    """
    return quality.apply_policy(quality.quality_ledger(docs)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    The smallest id of a group stays (of equal ids one row; a null id only if no row of the
    group has one).  Texts without words are linked with nothing and stay; an empty
    table stays empty; other columns are not passed on.
    """
    return near_dup.one_of_each(docs.select(*COLUMNS), NEAR_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    A row goes if its own id and text hold a leak, so equal ids with other texts and
    null ids are judged by their texts; null and empty texts hold none and stay;
    with an empty benchmark all stay; other columns are not passed on.
    """
    docs = docs.select(*COLUMNS)
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (rows equal in id, text and source equally often).

    The mix works on ids, sizes and sources; texts move once, to the join with
    what it decided.
    """
    key = [F.col("doc_id"), F.xxhash64("text"), F.col("source")]
    narrow = docs.select(F.col("doc_id"), "source", F.xxhash64("text").alias("__hash"), word_count(F.col("text")).alias("__words"))
    weighted = mix.quality_weight(narrow, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    mixed = mix.mix_sources(weighted, F.col("__words"), F.col("__quality")).where("copies > 0")
    taken = mixed.groupBy("doc_id", "__hash", "source").agg(F.max("copies").alias("__copies")).toDF("__id", "__hash", "__source", "__copies")
    same = key[0].eqNullSafe(F.col("__id")) & (key[1] == F.col("__hash")) & key[2].eqNullSafe(F.col("__source"))
    joined = docs.select(*COLUMNS).join(taken.hint("merge"), same)
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*COLUMNS)


def shard_by_key(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot; all copies of a document share its shard.

    A null id has a shard as any other; rows of equal id are ordered by a checksum of
    the text (null: that of no text); each row keeps its own slot; an empty table
    stays empty; other columns are not passed on.
    """
    sharded = shard.assign_shards(docs.select(*COLUMNS))
    return shard.number_slots(sharded, shard.text_crc32(F.col("text"))).select(*COLUMNS, "shard", "slot", "grown_shard")


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark leaks", drop_leaks),
    ("mix", mix_to_targets),
    ("shards", shard_by_key),
]

#: the stages of whole-text hashing and edit distances have no SQL; run() is tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
