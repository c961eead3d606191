"""Skew-safe building blocks used by several operators.

* ``prefix_agg``  - running min/max/sum per key in a fixed order, computed in
  blocks so a key holding a third of all rows is spread over many tasks.
* ``keep_first``  - first row per key under an explicit order, pruned map-side.
* ``spread``      - partitions by number of rows, so a task's memory does not grow.
* ``attach``      - a left join that leaves tables where a part of its columns put them.
* ``small``       - a table to be sent to every task, if it has few rows.
* ``dense_index`` - 0..n-1 numbering in a global order without a window over
  all rows (range partitions written once, their counts and offsets).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.session import materialize

_AGG = {"min": F.min, "max": F.max, "sum": F.sum}
_COMBINE = {"min": F.least, "max": F.greatest}


def _combine(fn: str, a: Column, b: Column) -> Column:
    if fn in _COMBINE:  # least/greatest skip NULLs
        return _COMBINE[fn](a, b)
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
        F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


#: rows of a partition of ``spread``; rows of a table that ``small`` lets every task have
SPREAD_ROWS, SMALL_ROWS = 1 << 19, 1 << 18


def spread(df: DataFrame, n_rows: int, *by: str) -> DataFrame:
    """``df`` (of about ``n_rows`` rows) hashed by ``by`` into partitions of about ``SPREAD_ROWS`` rows.

    Sorts and maps of a task hold its partition, so what a task holds must not
    depend on a fixed number of partitions.  A small table stays as it is.
    """
    if n_rows <= SPREAD_ROWS:
        return df
    return df.repartition(max(-(-n_rows // SPREAD_ROWS), df.sparkSession.sparkContext.defaultParallelism), *by)


def small(df: DataFrame, name: str = "small") -> DataFrame:
    """``df`` written once, and marked for broadcast if it has at most ``SMALL_ROWS`` rows.

    For lookups with few keys that many rows share: joined by a shuffle, those rows
    would meet in a partition per key.
    """
    d = materialize(df, name)
    return F.broadcast(d) if d.count() <= SMALL_ROWS else d


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right``: a left join on ``keys``.

    A join deals both tables out by all of its columns, even where they lie by some
    of them.  Here the rows are united, and a window gives each row of ``left`` the rows
    of ``right`` with its keys: tables that lie by a part of ``keys`` are not shuffled,
    others once.
    """
    values = [c for c in right.columns if c not in keys]
    found = right.select(*keys, F.struct(*values).alias("_right"), F.lit(False).alias("_left"))
    both = left.withColumn("_left", F.lit(True)).unionByName(found, allowMissingColumns=True)
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])  # NULL matches nothing
    rows = F.when(known, F.collect_list("_right").over(Window.partitionBy(*keys)))
    out = both.withColumn("_rows", rows).filter("_left").select(*left.columns, F.explode_outer("_rows").alias("_right"))
    return out.select(*left.columns, *[F.col("_right")[v].alias(v) for v in values])


def prefix_agg(df: DataFrame, key: Sequence[str], order: str,
               specs: Sequence[tuple[str, str, Column | str, bool]],
               block_size: int | None = 1 << 14, last_flag: str | None = None, next_order: str | None = None,
               n_rows: int = 0) -> DataFrame:
    """Add running aggregates over rows of ``key`` ordered by ``order``.

    ``order`` must be an integer ordinal (dense or not).  ``specs`` entries are
    ``(out, fn, expr, inclusive)`` with fn in min/max/sum; ``inclusive=False``
    aggregates only the rows strictly before the current one.  ``last_flag``
    names an optional boolean column marking the last row of each key;
    ``next_order`` one with the ordinal of the key's next row (NULL for the last).

    Rows are cut into blocks of ``block_size`` ordinals: a window runs inside
    each (key, block) and the exclusive prefix over earlier blocks comes from
    a block-level table that is ``block_size`` times smaller.  With ``n_rows`` (about
    the rows of ``df``) the blocks are spread by it.

    ``block_size=None`` is for rows that lie by ``key`` already: a window per key, over
    which rows are neither shuffled nor computed twice.
    """
    key = list(key)
    if block_size is None:
        return _prefix_agg_whole(df, key, order, specs, last_flag, next_order)
    vals = [(expr if isinstance(expr, Column) else F.col(expr)).alias(f"_v{i}")
            for i, (_, _, expr, _) in enumerate(specs)]
    d = spread(df.select("*", F.floor(F.col(order) / F.lit(block_size)).alias("_blk"), *vals), n_rows, *key, "_blk")
    w_in = Window.partitionBy(*key, "_blk").orderBy(order)
    local = [_AGG[fn](f"_v{i}").over(
        w_in.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)).alias(f"_l{i}")
        for i, (_, fn, _, inclusive) in enumerate(specs)]
    if next_order:
        local.append(F.lead(order).over(w_in).alias("_ln"))
    d_local = d.select("*", *local)

    blocks = d.groupBy(*key, "_blk").agg(F.max(order).alias("_mx"), F.min(order).alias("_mn"),
                                         *[_AGG[fn](f"_v{i}").alias(f"_t{i}")
                                           for i, (_, fn, _, _) in enumerate(specs)])
    w_blk = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*key)
    after = [F.lead("_mn").over(Window.partitionBy(*key).orderBy("_blk")).alias("_bn")] if next_order else []
    blocks = blocks.select(*key, "_blk", F.max("_mx").over(w_all).alias("_kmx"), *after,
                           *[_AGG[fn](f"_t{i}").over(w_blk).alias(f"_p{i}")
                             for i, (_, fn, _, _) in enumerate(specs)])
    out = d_local.join(blocks, on=[*key, "_blk"], how="left")
    extra = [(F.col(order) == F.col("_kmx")).alias(last_flag)] if last_flag else []
    extra += [F.coalesce("_ln", "_bn").alias(next_order)] if next_order else []
    combined = [_combine(fn, F.col(f"_l{i}"), F.col(f"_p{i}")).alias(name)
                for i, (name, fn, _, _) in enumerate(specs)]
    keep = [F.col(c) for c in df.columns]
    return out.select(*keep, *extra, *combined)


def _prefix_agg_whole(df: DataFrame, key: list[str], order: str, specs: Sequence[tuple[str, str, Column | str, bool]],
                      last_flag: str | None, next_order: str | None) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order)
    known = reduce(and_, [F.col(k).isNotNull() for k in key])
    last = F.max(order).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # as with blocks, rows without a key have no last one
    extra = [F.when(known, F.col(order) == last).alias(last_flag)] if last_flag else []
    extra += [F.lead(order).over(w).alias(next_order)] if next_order else []
    running = [_AGG[fn](expr).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)).alias(name)
               for name, fn, expr, inclusive in specs]
    return df.select("*", *extra, *running)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per ``keys``: the first under ``order`` (ascending, NULLs last).

    ``row_number() = 1``: Spark puts a WindowGroupLimit before the shuffle, so a
    map task ships one row per key it has seen, and a hot key never lands in one
    task as raw rows.  The row itself (texts, maps) is carried, never compared.
    For a descending numeric order pass ``-F.col(x)``.
    """
    by = [(F.col(o) if isinstance(o, str) else o).asc_nulls_last() for o in order]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_first", first).filter("_first = 1").drop("_first")


def dense_index(df: DataFrame, order: Sequence[str], name: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Number rows 0..n-1 in ``order`` (a total order).

    The rows are range-partitioned, sorted and written once with their place in
    their partition.  Everything after reads those files, so partition, place
    and partition sizes come from the same rows, however the plan above is
    pruned or recomputed.  The offsets (one row per partition, the only thing
    broadcast) turn places into numbers.
    """
    order = list(order)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    d = materialize(placed.select("*", F.shiftright("_mid", 33).alias("_pid"),
                                  F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_loc")).drop("_mid"), "numbered")
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    # one row per partition: bounded by the partition count, safe to broadcast
    out = d.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_loc"))
    return out.drop("_pid", "_loc", "_off")
