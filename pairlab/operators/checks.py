"""Counts and checks that travel with a plan.

``observed`` counts rows while the plan runs (``DataFrame.observe``), so a result and
its counts come from one pass, without an action of their own.  ``Checked.verify``
holds the counts against rules once an action has run; what a single row can show
(an unknown key, a repeated entry) raises inside the plan instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairlab.functions.numeric import differs, py_strip
from pairlab.operators.augment import FAILED_COMPLETION
from pairlab.operators.scan import keep_first, spread


class CheckFailed(AssertionError):
    """A rule over observed counts does not hold."""


@dataclass
class Checked:
    """``rows``, what was counted while they were computed, and the rules that the counts must meet."""
    rows: DataFrame
    observation: Observation
    rules: Mapping[str, Callable[[dict], bool]] = field(default_factory=dict)

    def counts(self) -> dict[str, int]:
        """The counts of the first action on ``rows`` (waits for one)."""
        return {k: v or 0 for k, v in self.observation.get.items()}

    def verify(self) -> dict[str, int]:
        """The counts; raises ``CheckFailed`` with every rule that they break."""
        counts = self.counts()
        broken = [message for message, rule in self.rules.items() if not rule(counts)]
        if broken:
            raise CheckFailed(f"{'; '.join(broken)}: {counts}")
        return counts

    def write(self, path: str) -> dict[str, int]:
        """The rows written as Parquet in the one pass that also counts; then the rules."""
        self.rows.write.parquet(path)
        return self.verify()


def observed(df: DataFrame, rules: Mapping[str, Callable[[dict], bool]] | None = None, **counts: Column) -> Checked:
    """``df`` with named aggregates taken while it is computed."""
    seen = Observation()
    return Checked(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), seen, rules or {})


def drop_identity_pairs(df: DataFrame, *, slow: str = "src_code", ref: str = "tgt_code", stripped: str = "slower_program") -> Checked:
    """P1 with counts (n_pairs, n_identical); nothing left is an error."""
    marked = observed(df.withColumn("_differs", differs(slow, ref)),
                      {"no pair is left": lambda c: c["n_pairs"] > c["n_identical"]},
                      n_pairs=F.count(F.lit(1)), n_identical=F.count_if(~F.col("_differs")))
    rows = marked.rows.filter("_differs").drop("_differs").withColumn(stripped, py_strip(F.col(slow)))
    return Checked(rows, marked.observation, marked.rules)


def clean_code_rows(df: DataFrame, code: str = "code", *, most_dropped: float = 1.0) -> Checked:
    """P2 with counts (n_rows, n_null, n_empty); more than a share of ``most_dropped`` rows without code is an error."""
    c = F.col(code)
    rule = {f"more than {most_dropped:.0%} of the rows have no code": lambda n: n["n_null"] + n["n_empty"] <= most_dropped * n["n_rows"]}
    marked = observed(df, rule, n_rows=F.count(F.lit(1)), n_null=F.count_if(c.isNull()), n_empty=F.count_if(F.length(c) == 0))
    return Checked(marked.rows.filter(c.isNotNull() & (F.length(c) > 0)), marked.observation, marked.rules)


def drop_failed_completions(df: DataFrame, *, code: str = "code", sentinel: str = FAILED_COMPLETION, most_failed: float = 1.0) -> Checked:
    """F14 with counts (n_completions, n_failed): rows stay and are marked ``failed``."""
    failed = F.col(code).isNull() | (F.col(code) == F.lit(sentinel))
    rule = {f"more than {most_failed:.0%} of the completions failed": lambda n: n["n_failed"] <= most_failed * n["n_completions"]}
    return observed(df.withColumn("failed", failed), rule, n_completions=F.count(F.lit(1)), n_failed=F.count_if(F.col("failed")))


def complete_with_missing(results: DataFrame, reference: DataFrame, *, key: Sequence[str], fill: dict, order: Sequence[str] | None = None,
                          strict: bool = True) -> Checked:
    """J1 with its row arithmetic: n_reference = n_found + n_missing, counted in the pass that completes.

    ``strict``: a result whose key the reference does not have raises while the plan
    runs (then missing = reference - results); otherwise it is counted (n_unknown).
    ``is_filled`` marks the added rows.  A key with a NULL part meets no other.
    """
    key = list(key)
    ref = keep_first(reference, key, list(order or key)).withColumn("_ref", F.lit(True))
    have = results.select(*key).distinct().withColumn("_res", F.lit(True))
    both = ref.join(have, key, "full")
    if strict:
        named = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in key])
        unknown = F.raise_error(F.concat(F.lit("a result is not in the reference: "), named)).cast("boolean")
        both = both.withColumn("_ref", F.coalesce(F.col("_ref"), unknown))
    seen = Observation()
    both = both.observe(seen, F.count_if(F.col("_ref")).alias("n_reference"), F.count_if(F.col("_ref") & F.col("_res")).alias("n_found"),
                        F.count_if(F.col("_ref") & F.col("_res").isNull()).alias("n_missing"), F.count_if(F.col("_ref").isNull()).alias("n_unknown"))
    missing = both.filter(F.col("_ref") & F.col("_res").isNull())
    cols = [F.lit(fill[c]).cast(t).alias(c) if c in fill else (F.col(c) if c in ref.columns else F.lit(None)).cast(t).alias(c) for c, t in results.dtypes]
    rows = results.withColumn("is_filled", F.lit(False)).unionByName(missing.select(*cols, F.lit(True).alias("is_filled")))
    rules = {"reference = found + missing": lambda c: c["n_reference"] == c["n_found"] + c["n_missing"]}
    return Checked(rows, seen, rules)


def once_per_test(outputs: DataFrame, *, program: str = "program_id", problem: str = "problem_id", tc: str = "tc_no", output: str = "output") -> DataFrame:
    """A10's condition for signatures: every program has one output of each (problem, test) that it has any of.

    A second one raises while the plan runs.  The rows (counted first) are spread
    by program and test, so each task counts a bounded part of them; only the four
    columns are returned.
    """
    by = [problem, tc, program]
    counted = spread(outputs.select(*by, output), outputs.count(), *by).groupBy(*by).agg(F.first(output).alias(output), F.count(F.lit(1)).alias("_n"))
    named = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in by])
    twice = F.raise_error(F.concat(F.lit("several outputs of one test: "), named)).cast("string")
    return counted.select(*by, F.when(F.col("_n") == 1, F.col(output)).otherwise(twice).alias(output))
