"""Checked queries for RUNS."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import runs as rn
from pairlab.plans.fixtures import oracle_with, table, view
from pairlab.plans.registry import INF_SQL, fin, query, sdiv

_NUM = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


def _f1_sql(out: str, exp: str) -> str:
    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    lines = lambda c: (f"(CASE WHEN {strip(c)} = '' THEN []::VARCHAR[] "  # noqa: E731
                       f"ELSE string_split_regex({strip(c)}, '\\r\\n|[\\n\\r]') END)")
    ol, el = lines(out), lines(exp)
    ok = (f"CASE WHEN i <= len({ol}) AND ({ol}[i] = {el}[i] OR (regexp_matches({ol}[i], '{_NUM}') "
          f"AND regexp_matches({el}[i], '{_NUM}') AND abs(TRY_CAST({ol}[i] AS DOUBLE) - "
          f"TRY_CAST({el}[i] AS DOUBLE)) < 0.001)) THEN 1 ELSE 0 END")
    return (f"(CASE WHEN len({el}) = 0 THEN NULL ELSE "
            f"CAST(list_sum(list_transform(range(1, len({el}) + 1), lambda i: {ok})) AS DOUBLE) / len({el}) END)")


_F1 = f"""
, f AS (SELECT o.problem_id, o.tc_no, o.program_id, {_f1_sql('o.output', 'e.expected')} AS accuracy
  FROM v_outputs o JOIN v_expected e ON o.problem_id = e.problem_id AND o.tc_no = e.tc_no)
"""


def _f1(spark, sf):
    out = view(spark, sf, "v_outputs").select("problem_id", "tc_no", "program_id", rn.comparable_text("output").alias("o"))
    exp = view(spark, sf, "v_expected").select("problem_id", "tc_no", rn.expected_text("expected").alias("e"))
    return out.join(exp, ["problem_id", "tc_no"]).select(
        "problem_id", "tc_no", "program_id", rn.accuracy_of(F.col("o"), F.col("e")).alias("accuracy"))


# outputs of several lines: exact, near-equal numbers, missing and extra lines, padding
_LINES = """
, lo AS (SELECT problem_id, tc_no, program_id, CASE program_id % 5
    WHEN 0 THEN output || chr(10) || '2.0004' || chr(10) || 'end'
    WHEN 1 THEN '  ' || output || chr(13) || chr(10) || '2' || chr(10)
    WHEN 2 THEN output || chr(10) || '2.01' || chr(10) || 'end' || chr(10) || 'more'
    WHEN 3 THEN output ELSE '' END AS output FROM v_outputs)
, le AS (SELECT problem_id, tc_no, expected || chr(10) || '2.0' || chr(10) || 'end' AS expected FROM v_expected)
"""


@query("f1_output_accuracy_lines", oracle_with(["v_outputs", "v_expected"], _LINES + f"""
SELECT CAST(o.problem_id AS BIGINT) AS problem_id, CAST(o.tc_no AS BIGINT) AS tc_no, program_id,
  {fin(_f1_sql('o.output', 'e.expected'))} AS accuracy
FROM lo o JOIN le e ON o.problem_id = e.problem_id AND o.tc_no = e.tc_no"""))
def f1_output_accuracy_lines(spark, sf):
    o, k = F.col("output"), F.col("program_id") % 5
    text = (F.when(k == 0, F.concat(o, F.lit("\n2.0004\nend"))).when(k == 1, F.concat(F.lit("  "), o, F.lit("\r\n2\n")))
            .when(k == 2, F.concat(o, F.lit("\n2.01\nend\nmore"))).when(k == 3, o).otherwise(F.lit("")))
    out = view(spark, sf, "v_outputs").select("problem_id", "tc_no", "program_id", rn.comparable_text(text).alias("o"))
    exp = view(spark, sf, "v_expected").select("problem_id", "tc_no", rn.expected_text(F.concat("expected", F.lit("\n2.0\nend"))).alias("e"))
    return out.join(exp, ["problem_id", "tc_no"]).select(
        "problem_id", "tc_no", "program_id", rn.accuracy_of(F.col("o"), F.col("e")).alias("accuracy"))


@query("f1_output_accuracy", oracle_with(["v_outputs", "v_expected"], _F1 + f"""
SELECT CAST(problem_id AS BIGINT) AS problem_id, CAST(tc_no AS BIGINT) AS tc_no, program_id,
  {fin('accuracy')} AS accuracy FROM f"""))
def f1_output_accuracy(spark, sf):
    return _f1(spark, sf)


@query("a1_mean_accuracy", oracle_with(["v_outputs", "v_expected"], _F1 + f"""
SELECT CAST(problem_id AS BIGINT) AS problem_id, program_id, {fin('avg(accuracy)')} AS mean_acc,
  CAST(count(*) AS BIGINT) AS n_tests FROM f GROUP BY problem_id, program_id"""))
def a1_mean_accuracy(spark, sf):
    return rn.mean_accuracy(_f1(spark, sf), key=["problem_id", "program_id"])


@query("a4_accuracy_gate", oracle_with(["v_outputs", "v_expected"], _F1 + f"""
, m AS (SELECT problem_id, program_id, avg(accuracy) AS mean_acc FROM f GROUP BY problem_id, program_id)
SELECT CAST(problem_id AS BIGINT) AS problem_id, program_id, {fin('mean_acc')} AS mean_acc,
  coalesce(mean_acc < 0.95, true) AS gated,
  {fin(f'CASE WHEN coalesce(mean_acc < 0.95, true) THEN {INF_SQL} ELSE c_acctbal END')} AS agg_runtime
FROM m JOIN customer ON c_custkey = program_id"""))
def a4_accuracy_gate(spark, sf):
    acc = rn.mean_accuracy(_f1(spark, sf), key=["problem_id", "program_id"])
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("program_id"),
                                               F.col("c_acctbal").alias("agg_runtime"))
    return rn.accuracy_gate(acc.join(cust, "program_id")).select(
        "problem_id", "program_id", "mean_acc", "gated", "agg_runtime")


_FF = """
, ff AS (SELECT submission_id, seq, t, success,
    coalesce(max(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY submission_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS skipped FROM v_test_runs)
, ff2 AS (SELECT submission_id, seq, success AND NOT skipped AS success, skipped,
    CASE WHEN skipped THEN NULL ELSE t END AS t FROM ff)
"""


@query("w2_fail_fast", oracle_with(["v_test_runs"], _FF + f"""
SELECT submission_id, CAST(seq AS BIGINT) AS seq, success, skipped, {fin('t')} AS t FROM ff2"""))
def w2_fail_fast(spark, sf):
    return rn.fail_fast(view(spark, sf, "v_test_runs")).select(
        "submission_id", "seq", "success", "skipped", "t")


@query("a2_total_runtime", oracle_with(["v_test_runs"], _FF + f"""
SELECT submission_id, {fin(f'coalesce(sum(CASE WHEN success AND t IS NOT NULL THEN t ELSE {INF_SQL} END), {INF_SQL})')} AS agg_runtime,
  CAST(count(*) AS BIGINT) AS n_tests, CAST(count(*) FILTER (WHERE success) AS BIGINT) AS n_success,
  {fin(f'sum(CASE WHEN success THEN t END)')} AS passed_time
FROM ff2 GROUP BY submission_id"""))
def a2_total_runtime(spark, sf):
    tests = rn.fail_fast(view(spark, sf, "v_test_runs"))
    tot = rn.total_runtime(tests, tc="seq")
    passed = tests.groupBy("submission_id").agg(
        F.sum(F.when(F.col("success"), F.col("t"))).alias("passed_time"))
    return tot.join(passed, "submission_id").select(
        "submission_id", "agg_runtime", "n_tests", "n_success", "passed_time")


@query("a3_aligned_repeat_stats", oracle_with(["v_repeats"], f"""
, pt AS (SELECT submission_id, tc, count(t) AS n, count(*) FILTER (WHERE t IS NULL) AS nulls
         FROM v_repeats GROUP BY submission_id, tc)
, ps AS (SELECT submission_id, min(n) AS shortest, count(*) AS n_tests, max(nulls) AS nulls FROM pt GROUP BY submission_id)
, sums AS (SELECT r.submission_id, r.rep, sum(r.t) AS tot FROM v_repeats r JOIN ps USING (submission_id)
           WHERE r.rep < ps.shortest GROUP BY r.submission_id, r.rep)
, st AS (SELECT submission_id, avg(tot) AS m, stddev_pop(tot) AS s FROM sums GROUP BY submission_id)
SELECT submission_id, CAST(n_tests AS BIGINT) AS n_tests, CAST(shortest AS BIGINT) AS shortest,
  {fin(f'CASE WHEN nulls > 0 OR shortest = 0 THEN {INF_SQL} ELSE m END')} AS agg_runtime,
  {fin(f'CASE WHEN nulls > 0 OR shortest = 0 THEN {INF_SQL} ELSE s END')} AS agg_stdev
FROM ps LEFT JOIN st USING (submission_id)"""))
def a3_aligned_repeat_stats(spark, sf):
    return rn.aligned_repeat_stats(view(spark, sf, "v_repeats"))


_A3_NULLS = f"""
, rr AS (SELECT submission_id, tc, rep, CASE WHEN submission_id % 9 = 4 AND rep = 0 AND tc = 'click' THEN NULL ELSE t END AS t FROM v_repeats)
, pt AS (SELECT submission_id, tc, count(t) AS n, count(*) FILTER (WHERE t IS NULL) AS nulls FROM rr GROUP BY submission_id, tc)
, ps AS (SELECT submission_id, min(n) AS shortest, count(*) AS n_tests, max(nulls) AS nulls FROM pt GROUP BY submission_id)
, sums AS (SELECT r.submission_id, r.rep, sum(r.t) AS tot FROM rr r JOIN ps USING (submission_id) WHERE r.rep < ps.shortest GROUP BY r.submission_id, r.rep)
, st AS (SELECT submission_id, avg(tot) AS m, stddev_pop(tot) AS s FROM sums GROUP BY submission_id)
"""


def _null_repeats(spark, sf):
    return view(spark, sf, "v_repeats").withColumn("t", F.when(~((F.col("submission_id") % 9 == 4) & (F.col("rep") == 0) & (F.col("tc") == "click")), F.col("t")))


@query("a3_aligned_repeat_stats_nulls", oracle_with(["v_repeats"], _A3_NULLS + f"""
SELECT submission_id, nulls > 0 OR shortest = 0 AS is_broken,
  {fin(f'CASE WHEN nulls > 0 OR shortest = 0 THEN {INF_SQL} ELSE m END')} AS agg_runtime FROM ps LEFT JOIN st USING (submission_id)"""))
def a3_aligned_repeat_stats_nulls(spark, sf):
    """Some tests have a repeat without a time."""
    d = rn.aligned_repeat_stats(_null_repeats(spark, sf))
    return d.select("submission_id", F.coalesce(F.col("agg_runtime") == F.lit(float("inf")), F.lit(False)).alias("is_broken"), "agg_runtime")


@query("a17_repeat_stability_runs", oracle_with(["v_repeats"], f"""
, m AS (SELECT submission_id, rep % 3 AS run, tc, avg(t) AS t FROM v_repeats GROUP BY ALL)
, a AS (SELECT submission_id, tc, count(t) AS n_runs, avg(t) AS m, stddev_pop(t) AS s FROM m GROUP BY submission_id, tc)
SELECT submission_id, tc, CAST(n_runs AS BIGINT) AS n_runs, {fin('m')} AS mean, {fin('s')} AS std,
  {fin(sdiv('s', 'm'))} AS cv, coalesce({sdiv('s', 'm')} < 0.05, false) AS stable FROM a"""))
def a17_repeat_stability_runs(spark, sf):
    """Three runs of every test: the mean of each run first."""
    return rn.repeat_stability(view(spark, sf, "v_repeats").withColumn("run", F.col("rep") % 3), run="run")


@query("a17_repeat_stability", oracle_with(["v_repeats"], f"""
, a AS (SELECT submission_id, tc, count(t) AS n_runs, avg(t) AS m, stddev_pop(t) AS s
        FROM v_repeats GROUP BY submission_id, tc)
SELECT submission_id, tc, CAST(n_runs AS BIGINT) AS n_runs, {fin('m')} AS mean, {fin('s')} AS std,
  {fin(sdiv('s', 'm'))} AS cv, coalesce({sdiv('s', 'm')} < 0.05, false) AS stable FROM a"""))
def a17_repeat_stability(spark, sf):
    return rn.repeat_stability(view(spark, sf, "v_repeats"))


@query("j4_restore_missing_tests", oracle_with(["v_repeats"], """
, ex AS (SELECT DISTINCT user_id AS submission_id, event_type AS tc FROM events)
, res AS (SELECT submission_id, tc, count(*) AS n_times FROM v_repeats WHERE tc <> 'error'
          GROUP BY submission_id, tc)
SELECT ex.submission_id, ex.tc, CAST(coalesce(res.n_times, 0) AS BIGINT) AS n_times,
  res.n_times IS NOT NULL AS has_timing
FROM ex LEFT JOIN res USING (submission_id, tc)"""))
def j4_restore_missing_tests(spark, sf):
    ev = table(spark, sf, "events")
    expected = ev.select(F.col("user_id").alias("submission_id"), F.col("event_type").alias("tc")).distinct()
    res = (view(spark, sf, "v_repeats").filter(F.col("tc") != "error")
           .groupBy("submission_id", "tc").agg(F.count(F.lit(1)).alias("n_times")))
    out = rn.restore_missing_tests(res, expected)
    return out.select("submission_id", "tc", F.coalesce("n_times", F.lit(0)).alias("n_times"),
                      F.col("n_times").isNotNull().alias("has_timing"))


@query("j9_pair_versions", oracle_with(["v_repeats"], f"""
, r AS (SELECT *, CASE WHEN rep * 2 < count(*) OVER (PARTITION BY submission_id, tc) THEN 0 ELSE 1 END AS version
        FROM v_repeats)
, b AS (SELECT submission_id, version, sum(CASE WHEN tc <> 'error' THEN t ELSE {INF_SQL} END) AS rt
        FROM r GROUP BY submission_id, version)
, w AS (SELECT submission_id, coalesce(max(rt) FILTER (WHERE version = 0), {INF_SQL}) AS v0,
          coalesce(max(rt) FILTER (WHERE version = 1), {INF_SQL}) AS v1 FROM b GROUP BY submission_id)
, n AS (SELECT submission_id, version, count(*) AS n, count(*) FILTER (WHERE tc <> 'error') AS ok FROM r GROUP BY ALL)
, nw AS (SELECT submission_id, coalesce(max(n) FILTER (WHERE version = 0), 0) AS n0, coalesce(max(n) FILTER (WHERE version = 1), 0) AS n1,
   coalesce(max(ok) FILTER (WHERE version = 0), 0) AS ok0, coalesce(max(ok) FILTER (WHERE version = 1), 0) AS ok1 FROM n GROUP BY submission_id)
SELECT submission_id, {fin('v0')} AS agg_runtime_v0, {fin('v1')} AS agg_runtime_v1, {fin(sdiv('v0', 'v1'))} AS speedup,
  CAST(n0 AS BIGINT) AS n_tests_v0, CAST(n1 AS BIGINT) AS n_tests_v1, CAST(ok0 AS BIGINT) AS n_success_v0, CAST(ok1 AS BIGINT) AS n_success_v1
FROM w JOIN nw USING (submission_id)"""))
def j9_pair_versions(spark, sf):
    """Early half of every test's repeats as version 0, late half as version 1."""
    r = view(spark, sf, "v_repeats").withColumn("success", F.col("tc") != "error")
    n = r.groupBy("submission_id", "tc").agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(n, ["submission_id", "tc"]).withColumn("_early", F.col("rep") * 2 < F.col("_n"))
    return rn.pair_versions(r.filter("_early"), r.filter("NOT _early"))


_NUMTOK = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_V1 = fin(f"CASE WHEN regexp_matches(v1, '^[+-]?(nan|inf)$', 'i') THEN NULL "
          f"WHEN regexp_matches(v1, '{_NUMTOK}') THEN CAST(v1 AS DOUBLE) END")
_SIM = fin("max(CASE WHEN stat = 'sim_ticks' THEN TRY_CAST(v1 AS DOUBLE) END) / "
           "max(CASE WHEN stat = 'sim_freq' THEN TRY_CAST(v1 AS DOUBLE) END)")


_STATS = """
WITH l AS (SELECT doc_id AS run_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
, f AS (SELECT run_id, pos, line FROM l
        WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' AND NOT contains(line, 'Begin') AND NOT contains(line, 'End'))
, t AS (SELECT run_id, pos, string_split_regex(regexp_replace(regexp_replace(line, '#.*', ''), '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks FROM f)
, p AS (SELECT run_id, toks[1] AS stat, len(toks) - 1 AS n_values, replace(toks[2], '%', '') AS v1, toks[2] AS text1 FROM t WHERE len(toks) >= 2
        QUALIFY row_number() OVER (PARTITION BY run_id, toks[1] ORDER BY pos DESC) = 1)
"""


@query("s6_parse_run_stats", _STATS + f"""
SELECT run_id, stat, CAST(n_values AS BIGINT) AS n_values, {_V1} AS first_value, sha256(text1) AS first_text FROM p
UNION ALL
SELECT run_id, 'sim_seconds_precise', CAST(1 AS BIGINT), {_SIM}, NULL FROM p GROUP BY run_id""")
def s6_parse_run_stats(spark, sf):
    """Every text read as a stats file; a repeated key keeps its last line."""
    docs = table(spark, sf, "documents")
    lines = docs.select(F.col("doc_id").alias("run_id"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    d = rn.parse_run_stats(lines, ordinal="at")
    return d.select("run_id", "stat", F.size("values").alias("n_values"), F.get("values", F.lit(0)).alias("first_value"),
                    F.when(F.col("stat") != "sim_seconds_precise", F.sha2(F.get("texts", F.lit(0)), 256)).alias("first_text"))


@query("summarise_runs_job", oracle_with(["v_test_runs"], _FF + f"""
, m AS (SELECT submission_id, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS mean_acc,
          coalesce(sum(CASE WHEN success AND t IS NOT NULL THEN t ELSE {INF_SQL} END), {INF_SQL}) AS rt,
          count(*) FILTER (WHERE success) AS n_success FROM ff2 GROUP BY submission_id)
SELECT submission_id, {fin('mean_acc')} AS mean_acc, coalesce(mean_acc < 0.95, true) AS gated,
  {fin(f'CASE WHEN coalesce(mean_acc < 0.95, true) THEN {INF_SQL} ELSE rt END')} AS agg_runtime,
  CAST(n_success AS BIGINT) AS n_success FROM m"""))
def summarise_runs_job(spark, sf):
    tests = view(spark, sf, "v_test_runs").withColumn("tc_no", F.col("seq"))
    tests = rn.fail_fast(tests).withColumn("accuracy", F.when(F.col("success"), 1.0).otherwise(0.0))
    out = rn.summarise_runs(tests.drop("skipped", "error"), fail_fast_enabled=False)
    return out.select("submission_id", "mean_acc", "gated", "agg_runtime", "n_success")


@query("summarise_runs_full", oracle_with(["v_test_runs", "v_repeats"], f"""
, ts AS (SELECT *, 'v' || CAST(seq % 5 AS VARCHAR) AS expected, CASE WHEN seq % 7 = 3 THEN 'wrong' ELSE ' v' || CAST(seq % 5 AS VARCHAR) END AS output,
    submission_id % 8 <> 3 AS compiled FROM v_test_runs WHERE NOT (submission_id % 5 = 1 AND seq = 2))
, want AS (SELECT submission_id, seq FROM v_test_runs)
, full_ AS (SELECT want.submission_id, want.seq, coalesce(ts.success, false) AS success, ts.t, coalesce(ts.compiled, want.submission_id % 8 <> 3) AS compiled,
    CASE WHEN trim(ts.output) = ts.expected THEN 1.0 ELSE 0.0 END AS accuracy FROM want LEFT JOIN ts USING (submission_id, seq))
, ff AS (SELECT *, coalesce(max(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY submission_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS skipped FROM full_)
, f2 AS (SELECT submission_id, accuracy, compiled, success AND NOT skipped AND compiled AS success, CASE WHEN skipped THEN NULL ELSE t END AS t FROM ff)
, m AS (SELECT submission_id, avg(CASE WHEN compiled THEN accuracy ELSE 0.0 END) AS mean_acc, bool_or(compiled) AS compilation,
    coalesce(sum(CASE WHEN success AND t IS NOT NULL THEN t ELSE {INF_SQL} END), {INF_SQL}) AS rt, count(*) FILTER (WHERE success) AS n_success
  FROM f2 GROUP BY submission_id)
, pt AS (SELECT submission_id, tc, count(t) AS n, count(*) FILTER (WHERE t IS NULL) AS nulls FROM v_repeats WHERE submission_id % 4 <> 2 GROUP BY ALL)
, ps AS (SELECT submission_id, min(n) AS shortest, max(nulls) AS nulls FROM pt GROUP BY ALL)
, sums AS (SELECT r.submission_id, r.rep, sum(r.t) AS tot FROM v_repeats r JOIN ps USING (submission_id) WHERE r.rep < ps.shortest GROUP BY ALL)
, st AS (SELECT submission_id, avg(tot) AS bm, stddev_pop(tot) AS bs FROM sums GROUP BY ALL)
SELECT submission_id, compilation, {fin('mean_acc')} AS mean_acc, coalesce(mean_acc < 0.95, true) AS gated,
  {fin(f'CASE WHEN coalesce(mean_acc < 0.95, true) THEN {INF_SQL} ELSE rt END')} AS agg_runtime, CAST(n_success AS BIGINT) AS n_success,
  {fin('bm')} AS agg_runtime_binary, {fin('bs')} AS agg_stdev_binary
FROM m LEFT JOIN st USING (submission_id)"""))
def summarise_runs_full(spark, sf):
    """Outputs compared with expected texts, tests that were lost, programs that do not compile, and real timings."""
    runs = view(spark, sf, "v_test_runs")
    want = runs.select("submission_id", F.col("seq").alias("tc_no"), (F.col("submission_id") % 8 != 3).alias("compiled"), F.col("seq"),
                       F.concat(F.lit("v"), (F.col("seq") % 5).cast("string")).alias("expected"))
    have = runs.filter("NOT (submission_id % 5 = 1 AND seq = 2)").select(
        "submission_id", F.col("seq").alias("tc_no"), "success", "t",
        F.when(F.col("seq") % 7 == 3, F.lit("wrong")).otherwise(F.concat(F.lit(" v"), (F.col("seq") % 5).cast("string"))).alias("output"))
    out = rn.summarise_runs(have, want, repeats=view(spark, sf, "v_repeats").filter("submission_id % 4 <> 2").withColumnRenamed("tc", "tc_no"),
                            output="output", expected="expected", compiled="compiled")
    return out.select("submission_id", "compilation", "mean_acc", "gated", "agg_runtime", "n_success", "agg_runtime_binary", "agg_stdev_binary")
