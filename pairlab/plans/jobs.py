"""The composed table jobs a user calls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators import augment as au
from pairlab.operators import evaluate as ev
from pairlab.operators import prepare as pp
from pairlab.operators import reshape as rs
from pairlab.operators import scan
from pairlab.operators.evaluate import evaluate
from pairlab.operators.prepare import build_training_set
from pairlab.operators.retrieve import retrieve_prompts
from pairlab.operators.runs import compare_versions, summarise_runs
from pairlab.operators.scan import attach, spread
from pairlab.operators.texts import pages_to_text
from pairlab.sources import io


def mine_seeds(subs: DataFrame, *, outputs: DataFrame | None = None, expected: DataFrame | None = None,
               descriptions: DataFrame | None = None, tests: DataFrame | None = None,
               program: str = "submission_id", code: str | None = None, n: int = 10,
               mode: str = "top", seed: int = 0, min_tests: int = 20, top: int | None = 10) -> DataFrame:
    """P3 -> (A14) -> W3/A13 -> J2 -> F3 -> A15 -> O3: seed problems with their
    fastest correct program.  ``top`` submissions per problem are examined (None:
    all); problems rank by all their accepted submissions."""
    acc = au.accepted_finite(subs)
    passed = None
    if outputs is not None and expected is not None:
        passed = au.all_tests_pass(outputs, expected, program=program)
    seeds = au.fastest_correct(acc, passed, program=program, top=top)
    if descriptions is not None:
        seeds = au.attach_descriptions(seeds, descriptions)
        if code is not None:
            seeds = au.with_lengths(seeds, code=code)
    if tests is not None:
        seeds = seeds.join(au.count_tests(tests, minimum=min_tests), "problem_id")
    return au.sample_candidates(seeds, n, mode=mode, seed=seed)


def select_novel(outputs: DataFrame, *, kind: str = "kind", last_n: int = 20, completions: DataFrame | None = None,
                 request: str = "request_id", template: str = "template", code: str = "code", regular: bool = True) -> dict[str, DataFrame]:
    """F14 -> W5/J8/A8 -> A9/A10 -> W6/W7 -> A11 -> A16: novel candidates, one survivor per
    equivalence class with ids, the unique-program counts and the cost report.

    ``completions`` (request, program_id, template, code) are the requests that gave the
    candidates: a failed one (NULL or the sentinel) is never novel and costs nothing.
    ``costs`` then has a row per completion and ``cost_summary`` one row with totals and
    the cost per unique program.  ``regular=False`` counts unique programs by the general
    rule (programs may miss tests or have several outputs of one).
    """
    cands = outputs.filter(F.col(kind) == "candidate")
    refs = outputs.filter(F.col(kind) == "reference")
    if completions is not None:
        marked = au.drop_failed_completions(completions, code=code)
        ok = marked.filter("NOT failed").select("program_id").distinct()
        cands = cands.join(ok, "program_id", "left_semi")
    verdict = au.novelty_filter(cands, refs, outputs.select("problem_id", "tc_no"), last_n=last_n)
    # a program that is novel for one problem may not be for another
    novel = cands.join(verdict.filter("is_different").select("problem_id", "program_id"), ["problem_id", "program_id"], "left_semi")
    survivors = au.assign_ids(au.keep_one_per_cluster(novel), order=["program_id"])
    counts = au.unique_program_count(novel) if regular else au.unique_program_count_general(novel)
    out = {"verdict": verdict, "survivors": survivors, "counts": counts, "groups": au.output_groups(novel)}
    if completions is not None:
        costs = au.cost_report(completions, request=request, template=template, code=code)
        different = verdict.groupBy("program_id").agg(F.bool_or("is_different").alias("is_different"))
        out["costs"] = costs.join(different, "program_id", "left").withColumn("is_different", F.coalesce("is_different", F.lit(False)))
        totals = au.side_by_side(au.cost_summary(costs), counts)
        out["cost_summary"] = totals.withColumn("cost_per_unique", au.safe_divide(F.col("total_cost"), F.col("unique_programs")))
    return out


def evaluate_answers(pairs: DataFrame, measured: DataFrame, *, answers: str = "generated_answers", key: str = "src_id",
                     group: str = "problem_id", src: str = "src_code", tgt: str = "tgt_code", max_answers: int = 0,
                     values: Sequence[str] = ("accuracy", "agg_runtime"), threshold: float = 1.0) -> dict[str, DataFrame]:
    """EVAL from raw answers: P4 -> P1 -> P9 -> P5/P6 -> P2 -> P10 -> J1 -> W1 -> A5/A6 -> J3 -> A7 -> P7.

    ``pairs`` (key, group, src, tgt, src_agg_runtime, tgt_agg_runtime, answers: a list or
    its text) are cleaned of identical pairs; their answers become rows, empty ones
    go; ``measured`` (key, gen_idx, and ``values``, maps among them) joins what was
    measured of each answer.  The slow and the reference program keep their known
    runtimes (set aside, added back).  An input without any answer left is a failure.

    Returns what ``evaluate`` does, ``long`` (one row per program: key, code_type, code,
    values) and, for ``max_answers`` columns, ``wide``: one row per input with
    ``{code_type}_{value}`` for the programs and the first ``max_answers`` answers
    (a bounded sink; all answers are in ``long``).
    """
    # about as many answers as were measured; a task's share of either side is bounded (ordinary partitions do, unless too few)
    n = measured.count()
    n = n if n > scan.SPREAD_ROWS * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0
    if dict(pairs.dtypes)[answers] == "string":
        pairs = rs.parse_list_literal(pairs, [answers])
    pairs = ev.drop_identity_pairs(pairs, slow=src, ref=tgt)
    pairs = rs.rename_runtime_columns(pairs, mapping={"src_agg_runtime": "src_code_agg_runtime", "tgt_agg_runtime": "tgt_code_agg_runtime"})
    ids, types = [key, group, "src_code_agg_runtime", "tgt_code_agg_runtime"], ["src_code", "tgt_code"]
    # an input's answers are one cell of its row, so all that follows can lie by the input: dealt out for it once, after parsing
    dealt = spread(pairs, n, key) if n else pairs.repartition(key)
    rows = rs.explode_generations(dealt.select(*ids, answers), answers, keys=ids).withColumn("code_type", F.concat(F.lit("answer_"), F.col("gen_idx").cast("string")))
    known = rs.unpivot_code(pairs.select(*ids, F.col(src).alias("src_code"), F.col(tgt).alias("tgt_code")), ids, types)
    # all known programs are cached and no answer is: their other parts are empty, and would be computed to find that out
    (cached, _), (_, todo) = (rs.split_cached_rows(rs.clean_code_rows(d), types=types) for d in (known, rows))
    found = rs.clean_code_rows(rs.explode_generations(pairs, answers, keys=[key]))
    todo = attach(todo, spread(measured.select(key, "gen_idx", *values), n, key), [key, "gen_idx"])
    runtime = F.when(F.col("code_type") == "src_code", F.col("src_code_agg_runtime")).otherwise(F.col("tgt_code_agg_runtime"))
    cached = cached.withColumn("agg_runtime", runtime)
    gens = todo.select(key, group, F.col("src_code_agg_runtime").alias("src_runtime"), F.col("tgt_code_agg_runtime").alias("tgt_runtime"),
                       F.col("gen_idx").cast("int").alias("gen_idx"), "code", "accuracy", "agg_runtime")
    inputs = pairs.select(key, group, F.col("src_code_agg_runtime").alias("src_runtime"), F.col("tgt_code_agg_runtime").alias("tgt_runtime"))
    out = evaluate(gens, inputs, key=key, group=group, threshold=threshold, n_rows=0, found=found, block_size=None)
    out["long"] = rs.union_by_name(todo, cached).select(key, group, "code_type", "gen_idx", "code", *values)
    if max_answers:
        out["wide"] = rs.pivot_results(out["long"], key=key, types=[*types, *(f"answer_{i}" for i in range(max_answers))], values=list(values))
    return out


def describe_problems(pages: DataFrame, *, key: str = "problem_id", html: str = "html") -> DataFrame:
    """Problem descriptions from pages: block-aware text (F2), each distinct page read once."""
    return pages_to_text(pages, html, out="text_description").rows.drop(html)


def write_training_files(splits: Mapping[str, DataFrame], path: str, run_id: str, *, form: str = "prompt", template: str = "code_opt",
                         seed: int = 0, n: int = -1, key: str = "src_id", group: str = "problem_id", runtime: str | None = None, **kw) -> dict[str, str]:
    """PREP to files: W8 -> O2 -> F7/F10/F11 -> S8 in a versioned folder (S11), one per split.

    With ``runtime`` every pair gets its performance tag first (the slot
    ``pctile``).  Each split is shuffled and cut to ``n`` rows on its own and written
    as JSON lines below ``path/split/v=run_id``, which must not exist; earlier runs
    stay.  Returns the folders.
    """
    out = {}
    for name, pairs in splits.items():
        if runtime is not None:
            pairs = pp.performance_tag(pairs, group=group, runtime=runtime)
            kw = {**kw, "pctile": "pctile"} if form == "prompt" else kw
        rows = build_training_set(pairs, form=form, template=template, seed=seed, n=n, key=key, **kw)
        out[name] = f"{path}/{name}/v={run_id}"
        io.write_records(rows, out[name])
    return out


__all__ = ["build_training_set", "compare_versions", "describe_problems", "evaluate", "evaluate_answers", "mine_seeds", "retrieve_prompts",
           "select_novel", "summarise_runs", "write_training_files"]
