"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone: no ring
table, and growing from ``n`` to ``n + 1`` shards moves only the rows that the
new shard takes.  The method's generator is a 64-bit linear congruential one;
Spark's bigint arithmetic raises on overflow, so the 64-bit product is formed
from 32-bit halves whose partial products fit.

Only DataFrame and SQL expressions.  Slots are counted in two levels: rows are
numbered inside ``(shard, block)`` and the block's offset comes from a table of
``shards * blocks`` counts, so no task holds a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.llm.base import table

#: the method's multiplier, fixed by its publication
MULTIPLIER = 2862933555777941757
SHARDS = 40
#: blocks of a shard for numbering its rows
BLOCKS = 256

_K0, _K1 = MULTIPLIER & 0x7FFFFFFF, MULTIPLIER >> 31
_M = "4294967295L"


def _next(hi: str, lo: str) -> tuple[str, str]:
    """SQL of the two halves of ``key * MULTIPLIER + 1`` modulo 2**64."""
    terms = [f"{lo} * {_K0}L", f"shiftleft({lo} * {_K1}L, 31)", f"shiftleft({hi} * {_K0}L, 32)", f"shiftleft({hi} * {_K1}L, 63)"]
    low = " + ".join(f"(({t}) & {_M})" for t in terms) + " + 1L"
    high = " + ".join(f"shiftrightunsigned({t}, 32)" for t in terms)
    return f"(({high}) + shiftrightunsigned({low}, 32)) & {_M}", f"({low}) & {_M}"


def _steps(state: str, first: int, last: int, limit: int, small: int) -> str:
    """SQL: up to ``last - first + 1`` jumps below ``limit``; ``small`` gets the last landing below a smaller count."""
    hi, lo = _next("s.hi", "s.lo")
    step = f"named_struct('hi', {hi}, 'lo', {lo}, 'b', s.j, 'c', CASE WHEN s.j < {small} THEN s.j ELSE s.c END, 'j', s.j)"
    jump = "CAST(floor((t.b + 1) * (2147483648D / (shiftrightunsigned(t.hi, 1) + 1))) AS BIGINT)"
    return (f"aggregate(sequence({first}, {last}), {state}, (s, i) -> CASE WHEN s.j >= {limit} THEN s ELSE "
            f"transform(array({step}), t -> named_struct('hi', t.hi, 'lo', t.lo, 'b', t.b, 'c', t.c, 'j', {jump}))[0] END)")


def jump_state(key: str, shards: int) -> Column:
    """Struct with ``c`` (the shard of ``shards``) and ``b`` (that of ``shards + 1``) for the bigint column ``key``.

    24 jumps settle all but about one key in a billion at 40 shards; the rest
    go on for as many as there are shards (each jump moves up by one at least).
    """
    limit = shards + 1
    start = (f"named_struct('hi', shiftrightunsigned(`{key}`, 32), 'lo', `{key}` & {_M}, 'b', -1L, 'c', -1L, 'j', 0L)")
    first = _steps(start, 1, min(24, limit), limit, shards)
    if limit <= 24:
        return F.expr(first)
    rest = _steps("u", 25, limit, limit, shards)
    return F.expr(f"transform(array({first}), u -> CASE WHEN u.j >= {limit} THEN u ELSE {rest} END)[0]")


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (the shard if there were one more).

    A null key is the key 0.  Equal keys share a shard, repeated rows included.
    Columns of ``docs`` with these names are replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "grown_shard")]
    keyed = docs.select(*kept, F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0)).alias("__key"))
    jumped = keyed.withColumn("__jump", jump_state("__key", shards))
    return jumped.select(*kept, F.col("__jump.c").cast("int").alias("shard"), F.col("__jump.b").cast("int").alias("grown_shard"))


def text_crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; that of no bytes (0) for null."""
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint")


def number_slots(sharded: DataFrame, digest: Column, key: str = "doc_id", blocks: int = BLOCKS) -> DataFrame:
    """``sharded`` with ``slot``: 0, 1, 2, ... without gaps in each shard.

    Rows are ordered by a hash of the key, the key, then ``digest`` (a bigint of
    the row's content, such as its checksum), so a rerun gives the same slots;
    rows equal in all three are exchangeable.  A block is named by the key's hash
    and the digest, so also the rows of one hot key are split.  A slot column of
    the input is replaced.
    """
    kept = [F.col(f"`{c}`") for c in sharded.columns if c.lower() != "slot"]
    h = F.xxhash64(F.col(f"`{key}`"))
    block = F.pmod(F.xxhash64(h, digest), F.lit(blocks))
    rows = sharded.select(*kept, h.alias("__h"), digest.alias("__d"), block.alias("__block"))
    counts = rows.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("__shard"), F.col("__block").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("shard", "__block").orderBy("__h", F.col(f"`{key}`"), "__d")
    numbered = rows.withColumn("__slot", F.row_number().over(inside) - 1)
    # shards * blocks rows: a fixed bound, so the offsets may be broadcast
    joined = numbered.join(F.broadcast(offsets), F.col("shard").eqNullSafe(F.col("__shard")) & (F.col("__block") == F.col("__b")))
    return joined.select(*kept, (F.col("__before") + F.col("__slot")).cast("bigint").alias("slot"))


def op7_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 39 by their doc_id, with slots and the shard if there were 41."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"))
    out = number_slots(assign_shards(docs), F.col("text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
