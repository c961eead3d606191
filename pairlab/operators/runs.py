"""RUNS: turn benchmark run logs into per-submission metrics.

Inputs are long tables: one row per (submission, test) run, one row per
(submission, test, repeat) timing, one row per stats line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.numeric import INF, inf, nan_to_null, py_strip, safe_divide
from pairlab.operators.scan import keep_first, prefix_agg

# Message of a test skipped after an earlier failure.
SKIPPED_MESSAGE = "Previous testcase was incorrect or timed out, so skipping this testcase"

# A line is numeric when Python's float() would accept it (underscore digit
# groups are not supported).  Java's parser would also accept "1d"/"1f".
_NUMERIC = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?|nan)\s*$"
# str.splitlines() boundaries
_BREAK_CLASS = "[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
_LINE_BREAK = "\r\n|" + _BREAK_CLASS


def text_lines(c) -> Column:
    """strip() then splitlines(): an empty text has no lines."""
    s = py_strip(F.col(c) if isinstance(c, str) else c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, _LINE_BREAK))


def _number(line: Column) -> Column:
    return F.when(line.rlike(_NUMERIC), line.try_cast("double"))


def comparable_text(c) -> Column:
    """What ``output_accuracy`` needs of a text: stripped, its number if it is one
    numeric line, its lines if there are several.  Computed once per text, so an
    expected output shared by many programs is prepared before it is joined."""
    s = py_strip(F.col(c) if isinstance(c, str) else c)
    single = F.length(F.translate(s, _BREAK_CLASS[1:-1], "")) == F.length(s)
    return F.struct(s.alias("text"), F.when(single, _number(s)).alias("number"),
                    F.when(~single, F.split(s, _LINE_BREAK)).alias("lines"))


def expected_text(c) -> Column:
    """``comparable_text`` of an expected output, with the number of every line: they
    are taken once per expected text, not once per output that meets it."""
    t = comparable_text(c)
    lines = F.when(t["lines"].isNotNull(), t["lines"]).when(t["text"] == "", F.array().cast("array<string>")).otherwise(F.array(t["text"]))
    return t.withField("entries", F.transform(lines, lambda x: F.struct(x.alias("line"), _number(x).alias("number"))))


def _same(a: Column, b: Column, x: Column, y: Column, tol: float) -> Column:
    return F.coalesce((a == b) | (F.abs(x - y) < F.lit(tol)), F.lit(False))


def accuracy_of(out: Column, expected: Column, tol: float = 1e-3) -> Column:
    """F1 over a ``comparable_text`` and an ``expected_text`` column."""
    lines = F.when(out["lines"].isNotNull(), out["lines"]).when(out["text"] == "", F.array().cast("array<string>")).otherwise(F.array(out["text"]))
    # equal lines first; only unequal ones that should be a number are tried as one
    near = lambda a, e: F.when(e["number"].isNotNull(), F.abs(_number(a) - e["number"]) < F.lit(tol))
    hit = lambda a, e: F.coalesce((a == e["line"]) | near(a, e), F.lit(False)).cast("int")
    hits = F.aggregate(F.zip_with(lines, expected["entries"], hit), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    one = F.when(_same(out["text"], expected["text"], out["number"], expected["number"], tol), F.lit(1.0)).otherwise(F.lit(0.0))
    single = out["lines"].isNull() & expected["lines"].isNull()
    return (F.when(out["text"].isNull() | expected["text"].isNull() | (expected["text"] == ""), F.lit(None).cast("double"))
            .when(single, one).otherwise(hits / F.size(expected["entries"])))


def output_accuracy(out, expected, tol: float = 1e-3) -> Column:
    """share of expected lines matched by the output, line by line.

    Lines pair up in order (extra output lines are ignored, missing ones are
    wrong); a pair matches when equal or both numeric within ``tol``.  An empty
    expected text gives NULL.
    """
    return accuracy_of(comparable_text(out), expected_text(expected), tol)


def mean_accuracy(tests: DataFrame, *, key: Sequence[str] = ("submission_id",),
                  accuracy: str = "accuracy", compiled: str | None = None) -> DataFrame:
    """A1: mean of per-test accuracy; a compile failure counts 0 on every test."""
    acc = nan_to_null(F.col(accuracy))
    if compiled:
        acc = F.when(F.col(compiled), acc).otherwise(F.lit(0.0))
    return tests.groupBy(*key).agg(F.avg(acc).alias("mean_acc"), F.count(F.lit(1)).alias("n_tests"))


def total_runtime(tests: DataFrame, *, key: Sequence[str] = ("submission_id",),
                  tc: str = "tc_no", success: str = "success", time: str = "t",
                  map_limit: int | None = None) -> DataFrame:
    """A2: sum of test times where a failed test, or one without a time, costs +inf
    (no results: +inf).

    ``map_limit`` adds the per-test maps ``tc2time`` / ``tc2success``; a submission
    with more tests than that raises, since a map is one collected group.
    """
    t = F.coalesce(F.when(F.col(success), nan_to_null(F.col(time))), inf())
    aggs = [F.coalesce(F.sum(t), inf()).alias("agg_runtime"),
            F.count(F.lit(1)).alias("n_tests"),
            F.count_if(F.col(success)).alias("n_success"),
            F.lit(0.0).alias("agg_stdev")]
    totals = tests.groupBy(*key).agg(*aggs)
    if map_limit is None:
        return totals
    return totals.join(per_test_maps(tests, key=key, tc=tc, limit=map_limit, values={"tc2time": t, "tc2success": F.col(success)}), list(key))


def fail_fast(tests: DataFrame, *, key: str = "submission_id", seq: str = "seq",
              success: str = "success", time: str = "t", enabled: bool = True) -> DataFrame:
    """After the first failed test of a submission, later tests are skipped.

    Skipped rows get success=false, no time and a fixed message.  The running
    "any earlier failure" is a blocked prefix scan (hot submissions split).
    """
    if not enabled:
        return tests.withColumn("skipped", F.lit(False)).withColumn("error", F.lit(None).cast("string"))
    d = prefix_agg(tests, [key], seq, [("_prior_fail", "max", (~F.col(success)).cast("int"), False)])
    skipped = F.coalesce(F.col("_prior_fail") == 1, F.lit(False))
    return (d.withColumn("skipped", skipped)
            .withColumn(success, F.col(success) & ~skipped)
            .withColumn(time, F.when(skipped, F.lit(None).cast("double")).otherwise(F.col(time)))
            .withColumn("error", F.when(skipped, F.lit(SKIPPED_MESSAGE)))
            .drop("_prior_fail"))


def accuracy_gate(df: DataFrame, *, accuracy: str = "mean_acc", runtime: str = "agg_runtime",
                  threshold: float = 0.95) -> DataFrame:
    """A4: below the accuracy gate (strict <) timing is not measured: runtime +inf."""
    gated = F.coalesce(nan_to_null(F.col(accuracy)) < F.lit(threshold), F.lit(True))
    return (df.withColumn("gated", gated)
            .withColumn(runtime, F.when(F.col("gated"), inf()).otherwise(F.col(runtime))))


def restore_missing_tests(results: DataFrame, expected: DataFrame, *,
                          key: Sequence[str] = ("submission_id", "tc")) -> DataFrame:
    """Expected tests left-joined to results; a test with no timing is NULL."""
    return expected.join(results, list(key), "left")


def repeats_from_arrays(df: DataFrame, *, times: str = "times",
                        keep: Sequence[str] = ("submission_id", "tc")) -> DataFrame:
    """(submission, test, times[]) -> one row per repeat; a NULL array keeps one NULL row."""
    return df.select(*keep, F.posexplode_outer(times).alias("rep", "t"))


def aligned_repeat_stats(repeats: DataFrame, *, key: str = "submission_id", tc: str = "tc",
                         rep: str = "rep", t: str = "t") -> DataFrame:
    """A3: cut every test's repeats to the shortest, sum per repeat, mean and population std.

    A test with a missing timing (NULL) or no repeats makes the submission +inf/+inf.
    Per-test counts and per-(submission, repeat) sums are partial aggregates.
    """
    per_test = repeats.groupBy(key, tc).agg(
        F.count(t).alias("_n"), F.count_if(F.col(t).isNull()).alias("_nulls"))
    per_sub = per_test.groupBy(key).agg(
        F.min("_n").alias("shortest"), F.count(F.lit(1)).alias("n_tests"),
        F.max("_nulls").alias("_nulls"))
    cut = repeats.join(per_sub.select(key, "shortest"), key).filter(F.col(rep) < F.col("shortest"))
    sums = cut.groupBy(key, rep).agg(F.sum(t).alias("_tot"))
    stats = sums.groupBy(key).agg(F.avg("_tot").alias("_mean"), F.stddev_pop("_tot").alias("_std"))
    broken = (F.col("_nulls") > 0) | (F.col("shortest") == 0)
    return per_sub.join(stats, key, "left").select(
        key, "n_tests", "shortest",
        F.when(broken, inf()).otherwise(F.col("_mean")).alias("agg_runtime"),
        F.when(broken, inf()).otherwise(F.col("_std")).alias("agg_stdev"))


def repeat_stability(repeats: DataFrame, *, key: Sequence[str] = ("submission_id", "tc"),
                     t: str = "t", bound: float = 0.05, run: str | None = None) -> DataFrame:
    """Coefficient of variation (population std / mean) of repeated runs < bound.

    With ``run`` (a run's repeats of one test) the mean of each run is taken
    first and the variation is between runs.
    """
    if run is not None:
        repeats = repeats.groupBy(*key, run).agg(F.avg(t).alias(t))
    agg = repeats.groupBy(*key).agg(F.count(t).alias("n_runs"), F.avg(t).alias("mean"),
                                    F.stddev_pop(t).alias("std"))
    cv = safe_divide(F.col("std"), F.col("mean"))
    return agg.withColumn("cv", cv).withColumn("stable", F.coalesce(F.col("cv") < F.lit(bound), F.lit(False)))


def _sum_runtime(success: Column, time: Column) -> Column:
    return F.sum(F.coalesce(F.when(success, nan_to_null(time)), inf()))


def pair_versions(v0: DataFrame, v1: DataFrame, *, key: str = "submission_id",
                  tc: str = "tc", success: str = "success", time: str = "t") -> DataFrame:
    """Totals, tests and passed tests of both versions side by side and the speedup v0 / v1.

    The two inputs are unioned with a ``version`` column and aggregated once;
    the pivot has explicit values, so no extra job discovers them.  A version
    with no results is +inf (the source summed an empty result to 0 here).
    """
    both = (v0.select(key, tc, success, time, F.lit("v0").alias("version"))
            .unionByName(v1.select(key, tc, success, time, F.lit("v1").alias("version"))))
    tot = both.groupBy(key, "version").agg(
        _sum_runtime(F.col(success), F.col(time)).alias("rt"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(success)).alias("ok"))
    wide = tot.groupBy(key).pivot("version", ["v0", "v1"]).agg(F.first("rt").alias("rt"), F.first("n").alias("n"), F.first("ok").alias("ok"))
    wide = wide.select(key, *[F.coalesce(F.col(f"{v}_rt"), inf()).alias(f"agg_runtime_{v}") for v in ("v0", "v1")],
                       *[F.coalesce(F.col(f"{v}_n"), F.lit(0)).alias(f"n_tests_{v}") for v in ("v0", "v1")],
                       *[F.coalesce(F.col(f"{v}_ok"), F.lit(0)).alias(f"n_success_{v}") for v in ("v0", "v1")])
    return wide.withColumn("speedup", safe_divide(F.col("agg_runtime_v0"), F.col("agg_runtime_v1")))


def per_test_maps(tests: DataFrame, *, key: Sequence[str] = ("submission_id",), tc: str = "tc_no", limit: int,
              values: dict[str, Column]) -> DataFrame:
    """Per-test results of a submission as maps test -> value.

    A map is one collected group, so it has a bound: a submission with more than
    ``limit`` tests raises (none is ever cut), and so does a test that occurs twice.
    """
    # checked on counts, before any map is built
    counted = tests.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    many = F.raise_error(F.concat(F.lit(f"more than {limit} tests: "), F.col("_n").cast("string"))).cast("boolean")
    bounded = tests.join(counted.filter(F.when(F.col("_n") <= limit, F.lit(True)).otherwise(many)).select(*key), list(key))
    maps = [F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(tc), c.alias("value"))))).alias(name) for name, c in values.items()]
    return bounded.groupBy(*key).agg(*maps)


def compare_versions(runs: DataFrame | None = None, *, repeats: DataFrame | None = None, accuracy: DataFrame | None = None, compilation: DataFrame | None = None,
                     key: str = "submission_id", version: str = "version", versions: Sequence[str] = ("v0", "v1"), tc: str = "tc_no",
                     together: bool = False, threshold: float | None = None, map_limit: int | None = None) -> DataFrame:
    """J9 in full: all results of two versions of a submission in one row, columns ``{name}_{version}``.

    Long inputs with a ``version`` column, each aggregated once: ``runs`` (key,
    version, tc, success, t) of simulated tests give ``agg_runtime``, ``agg_stdev``
    (0), ``n_tests`` and ``n_success``; ``repeats`` (key, version, tc, rep, t) give the
    aligned ``agg_runtime_binary`` and ``agg_stdev_binary`` (a NULL time makes both
    +inf; with ``together`` both versions are cut to the shortest of all their
    tests, so equal numbers of repeats are compared); ``accuracy`` (key, version,
    tc, accuracy) gives ``mean_acc``; ``compilation`` (key, version, compiled)
    gives ``compilation``: a version that does not compile has accuracy 0 and +inf
    runtimes.  ``threshold`` gates as A4 does.  ``map_limit`` adds the maps
    ``tc2time``, ``tc2success`` and ``accs``, raising beyond that many tests.
    A version without results is +inf.  ``speedup`` (and ``speedup_binary``) is the first
    version's runtime over the second's.
    """
    ids = [key, version]
    parts: list[DataFrame] = []
    names: dict[str, Column | None] = {}  # name -> what a version without results has
    if runs is not None:
        t = F.coalesce(F.when(F.col("success"), nan_to_null(F.col("t"))), inf())
        parts.append(runs.groupBy(*ids).agg(F.sum(t).alias("agg_runtime"), F.lit(0.0).alias("agg_stdev"), F.count(F.lit(1)).alias("n_tests"),
                                            F.count_if(F.col("success")).alias("n_success")))
        names |= {"agg_runtime": inf(), "agg_stdev": F.lit(0.0), "n_tests": F.lit(0), "n_success": F.lit(0)}
        if map_limit is not None:
            parts.append(per_test_maps(runs, key=ids, tc=tc, limit=map_limit, values={"tc2time": t, "tc2success": F.col("success")}))
            names |= {"tc2time": None, "tc2success": None}
    if repeats is not None:
        per_test = repeats.groupBy(*ids, tc).agg(F.count("t").alias("_n"), F.count_if(F.col("t").isNull()).alias("_nulls"))
        own = per_test.groupBy(*ids).agg(F.min("_n").alias("_own"), F.max("_nulls").alias("_nulls"))
        every = own.groupBy(key).agg(F.min("_own").alias("_every"))
        cut = own.join(every, key).withColumn("_short", F.col("_every") if together else F.col("_own"))
        sums = repeats.join(cut.select(*ids, "_short"), ids).filter(F.col("rep") < F.col("_short")).groupBy(*ids, "rep").agg(F.sum("t").alias("_t"))
        stats = sums.groupBy(*ids).agg(F.avg("_t").alias("_mean"), F.stddev_pop("_t").alias("_std"))
        broken = (F.col("_nulls") > 0) | (F.col("_short") == 0)
        parts.append(cut.join(stats, ids, "left").select(*ids, F.when(broken, inf()).otherwise(F.col("_mean")).alias("agg_runtime_binary"),
                                                         F.when(broken, inf()).otherwise(F.col("_std")).alias("agg_stdev_binary")))
        names |= {"agg_runtime_binary": inf(), "agg_stdev_binary": inf()}
    if accuracy is not None:
        parts.append(mean_accuracy(accuracy, key=ids).drop("n_tests"))
        names["mean_acc"] = None
        if map_limit is not None:
            parts.append(per_test_maps(accuracy, key=ids, tc=tc, limit=map_limit, values={"accs": F.col("accuracy")}))
            names["accs"] = None
    if compilation is not None:
        parts.append(compilation.groupBy(*ids).agg(F.bool_and(F.col("compiled")).alias("compilation")))
        names["compilation"] = F.lit(False)
    if not parts:
        raise ValueError("nothing to compare")
    long = parts[0]
    for p in parts[1:]:
        long = long.join(p, ids, "full")
    runtimes = [c for c in ("agg_runtime", "agg_stdev", "agg_runtime_binary", "agg_stdev_binary") if c in names]
    long = long.withColumns({n: F.coalesce(F.col(n), d) for n, d in names.items() if d is not None})
    if compilation is not None:
        ok = F.col("compilation")
        long = long.withColumns({c: F.when(ok, F.col(c)).otherwise(inf()) for c in runtimes})
        if accuracy is not None:
            long = long.withColumn("mean_acc", F.when(ok, F.col("mean_acc")).otherwise(F.lit(0.0)))
    if threshold is not None:
        gated = F.coalesce(nan_to_null(F.col("mean_acc")) < F.lit(threshold), F.lit(True))
        long = long.withColumn("gated", gated).withColumns({c: F.when(F.col("gated"), inf()).otherwise(F.col(c)) for c in runtimes})
        names["gated"] = F.lit(True)
    packed = F.struct(*names)
    wide = long.groupBy(key).pivot(version, list(versions)).agg(F.first(packed))
    # a version that has no row at all
    lost = {n: inf() if n in runtimes else d for n, d in names.items()}
    value = lambda v, n: F.col(f"`{v}`")[n] if lost[n] is None else F.coalesce(F.col(f"`{v}`")[n], lost[n])
    out = wide.select(key, *[value(v, n).alias(f"{n}_{v}") for v in versions for n in names])
    a, b = versions
    for c, name in (("agg_runtime", "speedup"), ("agg_runtime_binary", "speedup_binary")):
        if c in names:
            out = out.withColumn(name, safe_divide(F.col(f"{c}_{a}"), F.col(f"{c}_{b}")))
    return out


# ---- S6: simulator stats text ---------------------------------------------

def parse_run_stats(lines: DataFrame, *, key: str = "run_id", line: str = "line", ordinal: str | None = None) -> DataFrame:
    """Stats lines -> (run, stat, values array<double>, texts array<string>) plus
    the derived ``sim_seconds_precise = sim_ticks / sim_freq`` per run.

    Blank lines and Begin/End markers are dropped, ``#`` comments removed, lines
    with fewer than two tokens skipped.  ``texts`` keeps the tokens; ``values``
    has their numbers (without ``%``), NULL for other text, nan and inf.  With
    ``ordinal`` (the line's number) a stat that a run repeats keeps its last line.
    """
    raw = F.col(line)
    body = py_strip(F.regexp_replace(raw, "#.*", ""))
    toks = F.split(body, r"(?U)\s+")
    d = (lines.filter(~(py_strip(raw) == "") & ~raw.contains("Begin") & ~raw.contains("End"))
         .select(key, *([F.col(ordinal).alias("_at")] if ordinal else []), toks.alias("_t")).filter(F.size("_t") >= 2)
         .withColumn("stat", F.get("_t", F.lit(0))))
    if ordinal:
        d = keep_first(d, [key, "stat"], [-F.col("_at")])

    def value(tok):
        # a number is a token made only of digits, sign, point and exponent
        # characters that parses once '%' is dropped; nan/inf and other text
        # -> NULL (no regex per token; the cast runs only on numeric-looking
        # tokens, so failures that throw inside the cast stay rare)
        v = F.replace(tok, F.lit("%"), F.lit(""))
        only_numeric_chars = (F.length(F.translate(v, "0123456789+-.eE", "")) == 0) & (F.length(v) > 0)
        return F.when(only_numeric_chars, v.try_cast("double"))

    rest = F.slice("_t", F.lit(2), F.greatest(F.size("_t") - 1, F.lit(0)))
    parsed = d.select(key, "stat", F.transform(rest, value).alias("values"), rest.alias("texts"))
    first = lambda name: F.max(F.when(F.col("stat") == name, F.get("values", F.lit(0))))
    ticks = parsed.groupBy(key).agg(first("sim_ticks").alias("ticks"), first("sim_freq").alias("freq"))
    seconds = safe_divide(F.col("ticks"), F.col("freq"))
    derived = ticks.select(key, F.lit("sim_seconds_precise").alias("stat"), F.array(seconds).alias("values"), F.array(seconds.cast("string")).alias("texts"))
    return parsed.unionByName(derived)


def summarise_runs(tests: DataFrame, expected_tests: DataFrame | None = None, *,
                   repeats: DataFrame | None = None, key: str = "submission_id", tc: str = "tc_no", seq: str = "seq",
                   output: str | None = None, expected: str | None = None, compiled: str | None = None,
                   threshold: float = 0.95, fail_fast_enabled: bool = True) -> DataFrame:
    """Composed RUNS job: J4 -> F1 -> W2 -> A1 -> A4 -> A2 -> A3, one row per submission.

    ``tests`` has (submission, tc, seq, success, t, accuracy); with ``output``
    and ``expected`` the accuracy comes from the texts (F1).  ``compiled`` names
    the flag of a submission's compilation: without it every test counts 0 and
    the run costs +inf.  ``repeats`` (submission, tc, rep, t) are timings of the
    real program: their aligned mean and deviation come as the ``_binary`` twins
    (+inf for a submission without any).
    """
    if expected_tests is not None:
        tests = restore_missing_tests(tests, expected_tests, key=[key, tc]).withColumn(
            "success", F.coalesce(F.col("success"), F.lit(False)))
    if output is not None and expected is not None:
        tests = tests.withColumn("accuracy", F.coalesce(output_accuracy(output, expected), F.lit(0.0)))
    tests = fail_fast(tests, key=key, seq=seq, enabled=fail_fast_enabled)
    if compiled is not None:
        tests = tests.withColumn("success", F.col("success") & F.coalesce(F.col(compiled), F.lit(False)))
    acc = mean_accuracy(tests, key=[key], compiled=compiled)
    rt = total_runtime(tests, key=[key], tc=tc)
    out = accuracy_gate(acc.join(rt.drop("n_tests"), key), threshold=threshold)
    if compiled is not None:
        out = out.join(tests.groupBy(key).agg(F.coalesce(F.bool_or(compiled), F.lit(False)).alias("compilation")), key)
    if repeats is not None:
        real = aligned_repeat_stats(repeats, key=key, tc=tc).select(
            key, F.col("agg_runtime").alias("agg_runtime_binary"), F.col("agg_stdev").alias("agg_stdev_binary"))
        out = out.join(real, key, "left").withColumns({c: F.coalesce(c, inf()) for c in ("agg_runtime_binary", "agg_stdev_binary")})
    return out


__all__ = [n for n in dir() if not n.startswith("_")] + ["INF"]
