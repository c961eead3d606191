"""EVAL: score many model answers per input.

Long layout throughout: one row per (input, answer).  The source's wide
table with one column per answer only appears at a sink (``pivot_results``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.numeric import (
    differs, floored_speedup, inf, nan_to_null, reached, safe_divide,
)
from pairlab.operators.scan import keep_first, prefix_agg, spread

# Speedup thresholds of the report.
SPEEDUP_THRESHOLDS = (1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0)


def share_name(t: float) -> str:
    return "share_ge_" + str(t).replace(".", "_")


def adjusted_runtime(code: Column, accuracy: Column, runtime: Column, threshold: float) -> Column:
    """+inf when the answer is missing, has no accuracy or is below threshold."""
    acc = nan_to_null(accuracy)
    return (F.when(code.isNull() | acc.isNull() | (acc < F.lit(threshold)), inf())
            .otherwise(nan_to_null(runtime)))


def best_at_k(gens: DataFrame, *, key: str = "src_id", order: str = "gen_idx",
              base: str = "src_runtime", code: str = "code", accuracy: str = "accuracy",
              runtime: str = "agg_runtime", threshold: float = 1.0, floor: float = 1.0,
              keep: Sequence[str] = (), block_size: int | None = 1 << 14, n_rows: int = 0) -> DataFrame:
    """Best runtime / accuracy over the first k answers of each input.

    One row per (input, k) with k = order + 1 for the answers that exist; inputs
    with fewer answers, or with gaps between them (``next_k`` is the k of the next
    existing answer), are carried forward by ``best_at_k_summary`` rather than
    densified here.  Running aggregates use the blocked prefix scan, so an input
    with a huge number of answers is split across tasks (``block_size=None``: answers
    that lie by their input stay there).
    """
    d = gens.select(
        key, base, order, *keep,
        adjusted_runtime(F.col(code), F.col(accuracy), F.col(runtime), threshold).alias("_adj"),
        nan_to_null(F.col(accuracy)).alias("_acc"))
    d = prefix_agg(d, [key], order, [("best_runtime", "min", "_adj", True),
                                     ("best_accuracy", "max", "_acc", True)],
                   block_size=block_size, last_flag="is_last", next_order="_next", n_rows=n_rows)
    return d.select(
        key, *keep, base, (F.col(order) + 1).alias("k"), "is_last", (F.col("_next") + 1).alias("next_k"), "best_runtime", "best_accuracy",
        floored_speedup(F.col(base), F.col("best_runtime"), floor).alias("speedup"),
        F.coalesce(F.col("best_accuracy") == F.lit(threshold), F.lit(False)).alias("is_correct"))


def input_best(gens: DataFrame, *, key: str = "src_id", base: str = "src_runtime",
               code: str = "code", accuracy: str = "accuracy", runtime: str = "agg_runtime",
               threshold: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """Best runtime / accuracy over all answers of each input (W1 at the last k),
    as one partial aggregate: no ordering is needed for the final value."""
    acc = nan_to_null(F.col(accuracy))
    return gens.groupBy(key, *keep).agg(
        F.first(base, ignorenulls=True).alias(base),
        F.min(adjusted_runtime(F.col(code), F.col(accuracy), F.col(runtime), threshold)).alias("best_runtime"),
        F.max(acc).alias("best_accuracy"))


def input_runtimes(gens: DataFrame, *, key: str = "src_id", src: str = "src_runtime",
                   tgt: str = "tgt_runtime") -> DataFrame:
    """One row per input with its (per-input constant) slow and reference
    runtimes, as a plain hash aggregate."""
    return gens.groupBy(key).agg(F.max(src).alias(src), F.max(tgt).alias(tgt))


def best_at_k_summary(best: DataFrame, *, key: str = "src_id",
                      thresholds: Sequence[float] = SPEEDUP_THRESHOLDS, block_size: int = 1 << 14) -> DataFrame:
    """A5 (+A6 shares): mean accuracy, correctness and speedup for every k.

    An input counts at every k from its first answer on, with its value at its
    last answer up to k (what the wide form gives, since missing answers are
    +inf).  Instead of materialising inputs x k, each row marks where its statistics
    count: at k, for the last row of an input also from k + 1 on, for a row before
    a gap from k + 1 up to its next answer.  One aggregate by (k, kind of mark), then
    statistics as rows (stat, k) and one running sum over k per statistic.
    Infinite speedups are counted apart, so they end where their input does.
    """
    endless = F.coalesce(F.col("speedup") == inf(), F.lit(False))
    vals = {
        "n": F.lit(1).cast("long"),
        "sp": F.when(endless, F.lit(0.0)).otherwise(F.col("speedup")),
        "endless": endless.cast("long"),
        "acc": F.col("best_accuracy"),
        "accn": F.col("best_accuracy").isNotNull().cast("long"),
        "ok": F.col("is_correct").cast("long"),
        **{f"t{i}": reached(F.col("speedup"), t).cast("long") for i, t in enumerate(thresholds)},
    }
    k, mark = F.col("k").cast("long"), lambda at, kind: F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind"))
    marks = (F.when(F.col("is_last"), F.array(mark(k, 0), mark(k + 1, 1)))
             .when(F.col("next_k") > k + 1, F.array(mark(k, 0), mark(k + 1, 1), mark(F.col("next_k"), 2))).otherwise(F.array(mark(k, 0))))
    marked = best.select(F.inline(marks), *[v.alias(n) for n, v in vals.items()])
    sums = marked.groupBy("at", "kind").agg(*[F.sum(n).cast("double").alias(n) for n in vals])
    rows = sums.unpivot(["at", "kind"], list(vals), "stat", "value")
    kind, value = F.col("kind"), F.col("value")
    per_stat = rows.groupBy("stat", "at").agg(F.coalesce(F.sum(F.when(kind == 0, value)), F.lit(0.0)).alias("here"),
                                              F.sum(F.when(kind == 1, value).when(kind == 2, -value)).alias("carried"))
    # blocked running sum: its widest window has one row per block_size values of k
    running = prefix_agg(per_stat, ["stat"], "at", [("before", "sum", "carried", True)], block_size=block_size)
    total = F.col("here") + F.coalesce(F.col("before"), F.lit(0.0))
    of = lambda n, c: F.max(F.when(F.col("stat") == n, c))
    g = running.groupBy(F.col("at").alias("k")).agg(*[of(n, total).alias(n) for n in vals], of("n", F.col("here")).alias("_here")).filter("_here > 0")
    n = F.col("n")
    return g.select(
        "k",
        n.cast("long").alias("n_inputs"),
        safe_divide(F.col("acc"), F.col("accn")).alias("mean_accuracy"),
        safe_divide(F.col("ok"), n).alias("share_correct"),
        F.when(F.col("endless") > 0, inf()).otherwise(safe_divide(F.col("sp"), n)).alias("mean_speedup"),
        *[safe_divide(F.col(f"t{i}"), n).alias(share_name(t)) for i, t in enumerate(thresholds)])


def shares_long(df: DataFrame, ids: Sequence[str],
                thresholds: Sequence[float] = SPEEDUP_THRESHOLDS) -> DataFrame:
    """Wide ``share_ge_*`` columns -> rows (ids..., threshold, share)."""
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(share_name(t)).alias("share"))
                      for t in thresholds])
    return df.select(*ids, F.inline(pairs))


def speedup_shares(df: DataFrame, col: str, *, by: Sequence[str] = (),
                   thresholds: Sequence[float] = SPEEDUP_THRESHOLDS) -> DataFrame:
    """Share of rows whose ``col`` reaches each threshold (missing = not reached)."""
    wide = df.groupBy(*by).agg(*[F.avg(reached(F.col(col), t).cast("double")).alias(share_name(t))
                                 for t in thresholds])
    return shares_long(wide, list(by), thresholds)


def group_best(df: DataFrame, *, group: str = "problem_id", value: str = "best_runtime",
               base: str = "src_runtime", floor: float = 1.0) -> DataFrame:
    """Best value of the group attached to every row, correctness and speedup.

    A partial aggregate and an equi join back (AQE splits a hot group on the
    large side) instead of a window that would hold a hot group in one task.
    """
    best = df.groupBy(group).agg(F.min(value).alias("group_best"))
    return (df.join(best, group)
            .withColumn("group_correct", F.coalesce(F.col("group_best") < inf(), F.lit(False)))
            .withColumn("group_speedup", floored_speedup(F.col(base), F.col("group_best"), floor)))


def group_best_summary(df: DataFrame, thresholds: Sequence[float] = SPEEDUP_THRESHOLDS) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_inputs"),
        F.avg(F.col("group_correct").cast("double")).alias("share_correct"),
        F.avg(nan_to_null(F.col("group_speedup"))).alias("mean_speedup"),
        *[F.avg(reached(F.col("group_speedup"), t).cast("double")).alias(share_name(t))
          for t in thresholds])


def reference_speedup(df: DataFrame, *, src: str = "src_runtime", tgt: str = "tgt_runtime",
                      thresholds: Sequence[float] = SPEEDUP_THRESHOLDS) -> DataFrame:
    """Speedup of the reference program over the slow one (not floored).

    Mean skips missing values; a missing speedup stays in the share denominators.
    """
    sp = safe_divide(F.col(src), F.col(tgt))
    return df.select(sp.alias("_sp")).agg(
        F.count(F.lit(1)).alias("n_inputs"),
        F.avg("_sp").alias("mean_speedup"),
        *[F.avg(reached(F.col("_sp"), t).cast("double")).alias(share_name(t)) for t in thresholds])


def complete_with_missing(results: DataFrame, reference: DataFrame, *, key: Sequence[str],
                          fill: dict, order: Sequence[str] | None = None,
                          expected_rows: int | None = None, identity: Sequence[str] | None = None,
                          found: DataFrame | None = None) -> DataFrame:
    """Every reference item missing from the results is added as a failure.

    ``identity`` names one result (such as input and answer index): of several
    rows of one only the first by the filled columns stays.  Reference rows are deduplicated (first by ``order``), the missing ones found
    with a left anti join on the key (a tuple key, so no concatenation
    collisions), filled and unioned; ``is_filled`` marks them.  ``found`` has the keys of
    ``results`` where those are cheaper to take from another table.
    """
    key = list(key)
    if identity is not None:
        results = keep_first(results, identity, [c for c in fill if c in results.columns and c not in identity])
    ref = keep_first(reference, key, list(order or key))
    # distinct keys first (map-side): the anti join's right side cannot be
    # split by AQE, so a key repeated across many result rows must collapse
    missing = ref.join((results if found is None else found).select(*key).distinct(), key, "left_anti")
    cols = []
    for c, t in results.dtypes:
        if c in fill:
            cols.append(F.lit(fill[c]).cast(t).alias(c))
        elif c in ref.columns:
            cols.append(F.col(c).cast(t).alias(c))
        else:
            cols.append(F.lit(None).cast(t).alias(c))
    out = (results.withColumn("is_filled", F.lit(False))
           .unionByName(missing.select(*cols, F.lit(True).alias("is_filled"))))
    if expected_rows is not None:
        n = out.select(*key).distinct().count()
        if n != expected_rows:
            raise AssertionError(f"expected {expected_rows} items after completion, got {n}")
    return out


def drop_identity_pairs(df: DataFrame, *, slow: str = "src_code", ref: str = "tgt_code",
                        stripped: str = "slower_program") -> DataFrame:
    """Keep pairs whose slow program differs from the reference program (missing = different).

    The stripped slow program goes to a new column; the comparison uses the raw text.
    """
    from pairlab.functions.numeric import py_strip
    return df.filter(differs(slow, ref)).withColumn(stripped, py_strip(F.col(slow)))


def evaluate(gens: DataFrame, inputs: DataFrame | None = None, *, key: str = "src_id",
             group: str = "problem_id", threshold: float = 1.0,
             thresholds: Sequence[float] = SPEEDUP_THRESHOLDS, n_rows: int | None = None,
             found: DataFrame | None = None, block_size: int | None = 1 << 14) -> dict[str, DataFrame]:
    """Composed EVAL job: J1 -> W1 -> A5/A6 -> J3 -> A7.

    With ``inputs`` the answers are spread by ``n_rows`` (about their number; counted
    by default), so no task's sorts grow with the table; ``found`` has the keys of the answers
    (default: taken from ``gens``) and ``block_size`` is that of ``best_at_k``.  Returns lazily-built frames: per-(input, k) table, per-k summary, per-input
    group best, the one-row group summary and the reference speedup summary.
    """
    if inputs is not None:
        n_rows = gens.count() if n_rows is None else n_rows
        gens = complete_with_missing(
            spread(gens, n_rows, key, "gen_idx"), inputs, key=[key], identity=[key, "gen_idx"], found=found,
            fill={"gen_idx": 0, "accuracy": 0.0, "agg_runtime": float("inf"), "code": None})
    best = best_at_k(gens, key=key, threshold=threshold, block_size=block_size, n_rows=n_rows or 0)
    grouped = group_best(input_best(gens, key=key, threshold=threshold, keep=[group]), group=group)
    base = input_runtimes(gens, key=key)
    return {
        "best_at_k": best,
        "summary": best_at_k_summary(best, key=key, thresholds=thresholds),
        "group_best": grouped,
        "group_summary": group_best_summary(grouped, thresholds),
        "reference": reference_speedup(base, thresholds=thresholds),
    }
