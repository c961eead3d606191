"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose target is more than its size is taken in complete epochs first;
what remains of the target is a weighted sample without replacement: every
document draws an exponential key divided by its quality weight, documents are
sorted by key within the source, and the prefix sum of their sizes is cut at
the budget, after the document that brings it nearest.

Only DataFrame and SQL expressions.  Prefix sums run in two levels: inside
``(source, block)``, where a block is a range of keys, plus the sum of earlier
blocks, so a source that holds a third of the corpus is spread over ``blocks``
tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.llm.base import table, word_count, WORD

#: weights of the sources in code point order (null last), repeating
WEIGHTS = (5, 2, 1)
#: share of all sizes to take, and the most epochs of one source
SHARE, MAX_EPOCHS = 1.5, 2
#: weight of a document by its quality label: good, poor, none
QUALITY_WEIGHT = {1: 2.0, 0: 0.5, None: 1.0}
SEED = "mix-1"
#: key ranges of a source for its prefix sums
BLOCKS = 128


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of sources (``source``, ``source_size``): weight * level, at most ``max_epochs`` sizes.

    The level is the one at which the targets add up to ``share`` of all sizes:
    sources are taken by the level at which they fill up, and the first that
    does not fill up at the level of what is left fixes it.  That is where
    resharing the excess by weight, again and again, ends.  One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("__i"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(max_epochs)
    filled = ranked.select("source", "source_size", "__i", weight.alias("__w"), cap.alias("__cap"), (cap / weight).alias("__full"))
    rising = Window.orderBy("__full", "__i")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("__cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = ((F.sum("source_size").over(every) * float(share) - before) / F.sum("__w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    levels = filled.select("*", level.alias("__level")).withColumn("__capped", F.col("__full") <= F.col("__level"))
    first = F.min(F.when(~F.col("__capped"), F.struct("__full", "__i", "__level"))).over(every)
    return levels.select("source", "source_size", F.when(F.col("__capped"), F.col("__cap")).otherwise(F.col("__w") * first["__level"]).alias("target"))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """Exponential key of a document: ``-ln(u) / weight`` with ``u`` from a hash of seed and id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return -F.log((bits.cast("bigint") + 0.5) / float(1 << 52)) / weight


def mix_sources(docs: DataFrame, size: Column, weight: Column, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                max_epochs: int = MAX_EPOCHS, seed: str = SEED, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` (doc_id, source, ...) with size, source_size, target and copies (how often the mix takes the document).

    Null sources are a source of their own; documents of size 0 add nothing.
    Equal keys (repeated ids) go by doc_id, then size.  Columns of ``docs`` with
    the names of results are replaced.
    """
    new = ("size", "source_size", "target", "copies")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    keyed = docs.select(*kept, size.alias("size"), sampling_key(F.col("doc_id"), weight, seed).alias("__key"))
    keyed = keyed.withColumn("__block", F.floor(blocks * (1 - F.exp(-F.col("__key")))))
    totals = keyed.groupBy("source", "__block").agg(F.sum("size").alias("__sum"))
    earlier = Window.partitionBy("source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, share, max_epochs)
    offsets = offsets.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).select(
        F.col("source").alias("__source"), F.col("__block").alias("__b"), "__before", "source_size", "target")
    inside = Window.partitionBy("source", "__block").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumn("__upto", F.sum("size").over(inside))
    joined = summed.join(offsets, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__block") == F.col("__b")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    upto = F.col("__before") + F.col("__upto")
    chosen = (2 * upto - F.col("size") < 2 * rest).cast("int")
    return joined.select(*kept, "size", "source_size", "target", (epochs + chosen).cast("int").alias("copies"))


def quality_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``__quality``: the weight that the document's quality label gives.

    Of several labels of a document the best counts; null ids have none.
    """
    best = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__q"))
    weight = F.when(F.col("__q") == 1, QUALITY_WEIGHT[1]).when(F.col("__q") == 0, QUALITY_WEIGHT[0]).otherwise(QUALITY_WEIGHT[None])
    return docs.join(best, F.col("doc_id") == F.col("__id"), "left").withColumn("__quality", weight).drop("__id", "__q")


def op6_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed by the production weights; quality weights come from ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("__words"))
    docs = quality_weight(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    mixed = mix_sources(docs, F.col("__words"), F.col("__quality"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _oracle() -> str:
    weight = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
    return rf"""
WITH d AS (SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  CASE q WHEN 1 THEN {QUALITY_WEIGHT[1]} WHEN 0 THEN {QUALITY_WEIGHT[0]} ELSE {QUALITY_WEIGHT[None]} END::DOUBLE AS w
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
k AS (SELECT *, -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) / w AS key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM d GROUP BY source),
f AS (SELECT *, (CASE i % {len(WEIGHTS)} {weight} END)::DOUBLE AS w, source_size * {float(MAX_EPOCHS)}::DOUBLE AS cap FROM s),
v AS (SELECT *, cap / w AS fullness, (sum(source_size) OVER () * {SHARE}::DOUBLE
   - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN fullness <= level THEN cap
   ELSE w * (SELECT level FROM v WHERE fullness > level ORDER BY fullness, i LIMIT 1) END AS target FROM v),
c AS (SELECT k.doc_id, size, source_size, target, sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto,
   CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
   FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (epochs + CASE WHEN 2 * upto - size < 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""


ORACLE = _oracle()
