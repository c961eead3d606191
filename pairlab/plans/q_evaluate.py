"""Checked queries for EVAL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import evaluate as ev
from pairlab.plans.fixtures import oracle_with, view
from pairlab.plans.registry import INF_SQL, fin, floor1, query, sdiv

T = ev.SPEEDUP_THRESHOLDS

_G = f"""
, g AS (SELECT src_id, problem_id, src_runtime, tgt_runtime, gen_idx,
    CASE WHEN code IS NULL OR accuracy IS NULL OR isnan(accuracy) OR accuracy < 1.0 THEN {INF_SQL}
         ELSE agg_runtime END AS adj, accuracy FROM v_generations)
, r AS (SELECT src_id, problem_id, src_runtime, gen_idx + 1 AS k,
    min(adj) OVER w AS best_runtime, max(accuracy) OVER w AS best_accuracy FROM g
    WINDOW w AS (PARTITION BY src_id ORDER BY gen_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


def _shares_sql(col: str) -> str:
    return ", ".join(f"{fin(f'avg(CASE WHEN {col} >= {t} THEN 1.0 ELSE 0.0 END)')} AS {ev.share_name(t)}"
                     for t in T)


@query("w1_best_at_k", oracle_with(["v_generations"], _G + f"""
SELECT src_id, {fin('src_runtime')} AS src_runtime, CAST(k AS BIGINT) AS k,
  {fin('best_runtime')} AS best_runtime, {fin('best_accuracy')} AS best_accuracy,
  {fin(floor1(sdiv('src_runtime', 'best_runtime')))} AS speedup,
  coalesce(best_accuracy = 1.0, false) AS is_correct
FROM r"""))
def w1_best_at_k(spark, sf):
    return ev.best_at_k(view(spark, sf, "v_generations")).drop("is_last", "next_k")


_A5_SQL = _G + f"""
, lens AS (SELECT src_id, max(k) AS L FROM r GROUP BY src_id)
, ks AS (SELECT DISTINCT k FROM r)
, d AS (SELECT ks.k, r.best_accuracy, {floor1(sdiv('r.src_runtime', 'r.best_runtime'))} AS speedup,
    coalesce(r.best_accuracy = 1.0, false) AS ok
  FROM lens CROSS JOIN ks JOIN r ON r.src_id = lens.src_id AND r.k = least(ks.k, lens.L))
"""


@query("a5_best_at_k_summary", oracle_with(["v_generations"], _A5_SQL + f"""
SELECT CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n_inputs,
  {fin('avg(best_accuracy)')} AS mean_accuracy, {fin('avg(CAST(ok AS DOUBLE))')} AS share_correct,
  {fin('avg(speedup)')} AS mean_speedup, {_shares_sql('speedup')}
FROM d GROUP BY k"""))
def a5_best_at_k_summary(spark, sf):
    return ev.best_at_k_summary(ev.best_at_k(view(spark, sf, "v_generations")))


# answers that were cleaned away leave gaps, also before an input's first answer
_A5_GAPS = f"""
, gg AS (SELECT * FROM v_generations WHERE (src_id + gen_idx) % 4 <> 1)
, g AS (SELECT src_id, src_runtime, gen_idx,
    CASE WHEN code IS NULL OR accuracy IS NULL OR isnan(accuracy) OR accuracy < 1.0 THEN {INF_SQL}
         ELSE agg_runtime END AS adj, accuracy FROM gg)
, r AS (SELECT src_id, src_runtime, gen_idx + 1 AS k,
    min(adj) OVER w AS best_runtime, max(accuracy) OVER w AS best_accuracy FROM g
    WINDOW w AS (PARTITION BY src_id ORDER BY gen_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, ks AS (SELECT DISTINCT k FROM r)
, d AS (SELECT ks.k, r.best_accuracy, {floor1(sdiv('r.src_runtime', 'r.best_runtime'))} AS speedup,
    coalesce(r.best_accuracy = 1.0, false) AS ok
  FROM ks JOIN r ON r.k <= ks.k QUALIFY row_number() OVER (PARTITION BY ks.k, r.src_id ORDER BY r.k DESC) = 1)
"""


@query("a5_best_at_k_gaps", oracle_with(["v_generations"], _A5_GAPS + f"""
SELECT CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n_inputs,
  {fin('avg(best_accuracy)')} AS mean_accuracy, {fin('avg(CAST(ok AS DOUBLE))')} AS share_correct,
  {fin('avg(speedup)')} AS mean_speedup, {_shares_sql('speedup')}
FROM d GROUP BY k"""))
def a5_best_at_k_gaps(spark, sf):
    gens = view(spark, sf, "v_generations").filter("(src_id + gen_idx) % 4 <> 1")
    return ev.best_at_k_summary(ev.best_at_k(gens))


@query("a6_speedup_shares", oracle_with(["v_generations"], _A5_SQL + f"""
, t AS (SELECT unnest([{', '.join(str(t) for t in T)}]::DOUBLE[]) AS threshold)
SELECT CAST(k AS BIGINT) AS k, t.threshold,
  {fin('avg(CASE WHEN speedup >= t.threshold THEN 1.0 ELSE 0.0 END)')} AS share
FROM d CROSS JOIN t GROUP BY k, t.threshold"""))
def a6_speedup_shares(spark, sf):
    summary = ev.best_at_k_summary(ev.best_at_k(view(spark, sf, "v_generations")))
    return ev.shares_long(summary, ["k"])


_J3_SQL = f"""
, g AS (SELECT src_id, problem_id, src_runtime,
    CASE WHEN code IS NULL OR accuracy IS NULL OR isnan(accuracy) OR accuracy < 1.0 THEN {INF_SQL}
         ELSE agg_runtime END AS adj FROM v_generations)
, s AS (SELECT src_id, problem_id, any_value(src_runtime) AS src_runtime, min(adj) AS best_runtime
        FROM g GROUP BY src_id, problem_id)
, p AS (SELECT problem_id, min(best_runtime) AS group_best FROM s GROUP BY problem_id)
, j AS (SELECT s.*, p.group_best, coalesce(p.group_best < {INF_SQL}, false) AS group_correct,
    {floor1(sdiv('s.src_runtime', 'p.group_best'))} AS group_speedup FROM s JOIN p USING (problem_id))
"""


def _j3(spark, sf):
    return ev.group_best(ev.input_best(view(spark, sf, "v_generations"), keep=["problem_id"]))


@query("j3_group_best", oracle_with(["v_generations"], _J3_SQL + f"""
SELECT src_id, CAST(problem_id AS BIGINT) AS problem_id, {fin('best_runtime')} AS best_runtime,
  {fin('group_best')} AS group_best, group_correct, {fin('group_speedup')} AS group_speedup FROM j"""))
def j3_group_best(spark, sf):
    return _j3(spark, sf).select("src_id", "problem_id", "best_runtime", "group_best",
                                 "group_correct", "group_speedup")


@query("j3_group_best_summary", oracle_with(["v_generations"], _J3_SQL + f"""
SELECT CAST(count(*) AS BIGINT) AS n_inputs, {fin('avg(CAST(group_correct AS DOUBLE))')} AS share_correct,
  {fin('avg(group_speedup)')} AS mean_speedup, {_shares_sql('group_speedup')} FROM j"""))
def j3_group_best_summary(spark, sf):
    return ev.group_best_summary(_j3(spark, sf))


@query("a7_reference_speedup", oracle_with(["v_generations"], f"""
, s AS (SELECT DISTINCT src_id, src_runtime, tgt_runtime FROM v_generations)
, x AS (SELECT {sdiv('src_runtime', 'tgt_runtime')} AS sp FROM s)
SELECT CAST(count(*) AS BIGINT) AS n_inputs, {fin('avg(sp)')} AS mean_speedup, {_shares_sql('sp')} FROM x"""))
def a7_reference_speedup(spark, sf):
    g = view(spark, sf, "v_generations")
    return ev.reference_speedup(ev.input_runtimes(g))


@query("j1_complete_with_missing", oracle_with(["v_generations", "v_inputs"], f"""
SELECT src_id, CAST(problem_id AS BIGINT) AS problem_id, {fin('src_runtime')} AS src_runtime,
  {fin('tgt_runtime')} AS tgt_runtime, CAST(gen_idx AS BIGINT) AS gen_idx, code,
  {fin('accuracy')} AS accuracy, {fin('agg_runtime')} AS agg_runtime, false AS is_filled
FROM v_generations
UNION ALL
SELECT src_id, CAST(problem_id AS BIGINT), {fin('src_runtime')}, {fin('tgt_runtime')}, CAST(0 AS BIGINT),
  CAST(NULL AS VARCHAR), CAST(0.0 AS DOUBLE), CAST(NULL AS DOUBLE), true
FROM v_inputs i WHERE NOT EXISTS (SELECT 1 FROM v_generations g WHERE g.src_id = i.src_id)"""))
def j1_complete_with_missing(spark, sf):
    return ev.complete_with_missing(
        view(spark, sf, "v_generations"), view(spark, sf, "v_inputs"), key=["src_id"],
        fill={"gen_idx": 0, "accuracy": 0.0, "agg_runtime": float("inf"), "code": None})


@query("j1_complete_deduplicated", oracle_with(["v_generations", "v_inputs"], f"""
SELECT src_id, CAST(gen_idx AS BIGINT) AS gen_idx, code, {fin('accuracy')} AS accuracy, false AS is_filled FROM v_generations
UNION ALL
SELECT src_id, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0.0 AS DOUBLE), true
FROM v_inputs i WHERE NOT EXISTS (SELECT 1 FROM v_generations g WHERE g.src_id = i.src_id)"""))
def j1_complete_deduplicated(spark, sf):
    """Results that hold every seventh input's rows twice."""
    g = view(spark, sf, "v_generations")
    out = ev.complete_with_missing(
        g.unionByName(g.filter("src_id % 7 = 0")), view(spark, sf, "v_inputs"), key=["src_id"], identity=["src_id", "gen_idx"],
        fill={"gen_idx": 0, "accuracy": 0.0, "agg_runtime": float("inf"), "code": None})
    return out.select("src_id", "gen_idx", "code", "accuracy", "is_filled")


@query("a5_evaluate_with_missing", oracle_with(["v_generations", "v_inputs"], f"""
, gi AS (SELECT src_id, src_runtime, gen_idx, code, accuracy, agg_runtime FROM v_generations
   UNION ALL SELECT src_id, src_runtime, 0, NULL, 0.0, {INF_SQL} FROM v_inputs i
   WHERE NOT EXISTS (SELECT 1 FROM v_generations g WHERE g.src_id = i.src_id))
, g AS (SELECT src_id, src_runtime, gen_idx,
    CASE WHEN code IS NULL OR accuracy IS NULL OR isnan(accuracy) OR accuracy < 1.0 THEN {INF_SQL}
         ELSE agg_runtime END AS adj, accuracy FROM gi)
, r AS (SELECT src_id, src_runtime, gen_idx + 1 AS k,
    min(adj) OVER w AS best_runtime, max(accuracy) OVER w AS best_accuracy FROM g
    WINDOW w AS (PARTITION BY src_id ORDER BY gen_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, lens AS (SELECT src_id, max(k) AS L FROM r GROUP BY src_id)
, ks AS (SELECT DISTINCT k FROM r)
, d AS (SELECT ks.k, r.best_accuracy, {floor1(sdiv('r.src_runtime', 'r.best_runtime'))} AS speedup,
    coalesce(r.best_accuracy = 1.0, false) AS ok
  FROM lens CROSS JOIN ks JOIN r ON r.src_id = lens.src_id AND r.k = least(ks.k, lens.L))
SELECT CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n_inputs,
  {fin('avg(best_accuracy)')} AS mean_accuracy, {fin('avg(CAST(ok AS DOUBLE))')} AS share_correct,
  {fin('avg(speedup)')} AS mean_speedup, {_shares_sql('speedup')}
FROM d GROUP BY k"""))
def a5_evaluate_with_missing(spark, sf):
    res = ev.evaluate(view(spark, sf, "v_generations"), view(spark, sf, "v_inputs"))
    return res["summary"]


@query("p1_drop_identity_pairs", oracle_with(["v_pairs"], r"""
, p AS (SELECT src_id, problem_id, CASE WHEN src_id % 6 = 2 THEN tgt_code WHEN src_id % 17 = 5 THEN NULL ELSE src_code END AS src_code, tgt_code FROM v_pairs)
SELECT src_id, CAST(problem_id AS BIGINT) AS problem_id,
  regexp_replace(src_code, '^\s+|\s+$', '', 'g') AS slower_program
FROM p WHERE coalesce(src_code <> tgt_code, true)"""))
def p1_drop_identity_pairs(spark, sf):
    """Pairs of which some are identical and some lack the slow program."""
    k = F.col("src_id")
    p = view(spark, sf, "v_pairs").withColumn("src_code", F.when(k % 6 == 2, F.col("tgt_code")).when(k % 17 == 5, F.lit(None)).otherwise(F.col("src_code")))
    return ev.drop_identity_pairs(p).select("src_id", "problem_id", "slower_program")


@query("f13_floored_speedup", oracle_with(["v_generations"], f"""
SELECT src_id, CAST(gen_idx AS BIGINT) AS gen_idx, {fin(floor1(sdiv('src_runtime', 'agg_runtime')))} AS speedup
FROM v_generations"""))
def f13_floored_speedup(spark, sf):
    from pairlab.functions.numeric import floored_speedup
    g = view(spark, sf, "v_generations")
    return g.select("src_id", "gen_idx", floored_speedup(F.col("src_runtime"), F.col("agg_runtime")).alias("speedup"))
