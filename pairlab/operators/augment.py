"""AUG: select seeds, pair them for prompts, test novelty, cluster and dedupe.

Program outputs arrive normalised as (problem_id, tc_no, program_id, output).
Large output texts are hashed before any shuffle; equivalence between
programs is decided on *signatures* (an order-independent hash of all their
(problem, test, output) entries) so no step emits all pairs of programs that
agree, and no group is ever collected.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions.numeric import is_finite, py_strip, safe_divide
from pairlab.functions.text import canonical_newlines, seeded_hash, token_length
from pairlab.operators.scan import dense_index, keep_first, small
from pairlab.session import materialize

# Outputs that mean the program did not run to completion, the
# sentinel of a failed completion request and the token prices per 1000.
RUN_FAILURES = ("timeout", "error")
FAILED_COMPLETION = "Openai timed out"
PROMPT_RATE_PER_1K = 0.003
COMPLETION_RATE_PER_1K = 0.004


def accepted_finite(df: DataFrame, *, runtime: str = "agg_runtime", status: str | None = "status",
                    accepted: str = "Accepted") -> DataFrame:
    """Keep accepted submissions with a finite runtime (status check optional)."""
    cond = is_finite(F.col(runtime))
    if status:
        cond = cond & (F.col(status) == F.lit(accepted))
    return df.filter(cond)


def top_n_per_problem(subs: DataFrame, *, n: int | None = 10, group: str = "problem_id",
                      order: Sequence[str] = ("agg_runtime", "submission_id")) -> DataFrame:
    """The n fastest submissions per problem (ties by id); all of them, unranked, for n=None.

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a hot problem ships at most n rows per map task.
    """
    if n is None:
        return subs
    w = Window.partitionBy(group).orderBy(*order)
    return subs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_tests(tests: DataFrame, *, n: int = 20, group: str = "problem_id",
              tc: str = "tc_no") -> DataFrame:
    """The n highest (numeric) test ids of each problem."""
    w = Window.partitionBy(group).orderBy(F.col(tc).desc())
    return tests.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def count_tests(tests: DataFrame, *, minimum: int = 20, group: str = "problem_id") -> DataFrame:
    """Tests per problem, keeping problems with at least ``minimum``."""
    return tests.groupBy(group).agg(F.count(F.lit(1)).alias("n_tests")).filter(
        F.col("n_tests") >= minimum)


def all_tests_pass(outputs: DataFrame, expected: DataFrame, *, problem: str = "problem_id",
                   program: str = "program_id", tc: str = "tc_no", output: str = "output",
                   truth: str = "expected") -> DataFrame:
    """A program passes its problem when its stripped output equals the
    stripped expected output on every expected test.

    Run failures always fail, a missing output fails, zero expected tests pass.
    """
    # stripped once per (problem, test) and once per output, before they meet
    want = expected.select(problem, tc, py_strip(F.col(truth)).alias("_want"))
    have = outputs.select(problem, tc, program, F.when(~F.col(output).isin(*RUN_FAILURES), py_strip(F.col(output))).alias("_have"))
    ok = F.col("_have") == F.col("_want")
    j = have.join(want, [problem, tc], "left")
    per = j.groupBy(problem, program).agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("n_match"))
    n_exp = expected.groupBy(problem).agg(F.count(F.lit(1)).alias("n_expected"))
    return per.join(n_exp, problem, "left").select(
        problem, program, (F.col("n_match") == F.coalesce(F.col("n_expected"), F.lit(0))).alias("passed"))


def fastest_correct(subs: DataFrame, passed: DataFrame | None = None, *, top: int | None = 10,
                    group: str = "problem_id", program: str = "program_id",
                    runtime: str = "agg_runtime") -> DataFrame:
    """Fastest submission per problem that passes every test.

    Only the ``top`` fastest are examined (None: all) and ``num_submissions``
    counts them; ``n_accepted`` counts all before the cut.  With ``passed=None``
    every submission counts as correct.
    """
    ranked = top_n_per_problem(subs, n=top, group=group, order=(runtime, program))
    ok = ranked
    if passed is not None:
        ok = ranked.join(passed.filter("passed").select(group, program), [group, program], "left_semi")
    best = keep_first(ok.drop("rank"), [group], [runtime, program])
    num = subs.groupBy(group).agg(F.count(F.lit(1)).alias("n_accepted"))
    cut = F.col("n_accepted") if top is None else F.least(F.col("n_accepted"), F.lit(top))
    num = num.withColumn("num_submissions", cut.cast("long"))
    return best.join(num, group)


def attach_descriptions(df: DataFrame, desc: DataFrame, *, key: str = "problem_id",
                        deny: DataFrame | None = None, how: str = "left") -> DataFrame:
    """Attach the problem description (left lookup by default, inner to
    keep only described problems) and drop keys on a deny-list."""
    out = df.join(desc, key, how)
    if deny is not None:
        out = out.join(deny.select(key).distinct(), key, "left_anti")
    return out


def with_lengths(df: DataFrame, *, code: str = "code", description: str = "text_description",
                 tokenizer=None) -> DataFrame:
    """Token lengths of code and description; a missing description is 0 long."""
    return (df.withColumn("code_length", token_length(F.col(code), tokenizer))
            .withColumn("text_description_length",
                        F.when(F.col(description).isNull(), F.lit(0))
                        .otherwise(token_length(F.col(description), tokenizer)))
            .withColumn("total_length", F.col("code_length") + F.col("text_description_length")))


def sample_candidates(df: DataFrame, n: int, *, mode: str = "top", seed: int = 0,
                      key: str = "problem_id", order: str = "n_accepted") -> DataFrame:
    """O3: n problems, either the top by ``order`` or a seeded random sample."""
    if mode == "top":
        return df.orderBy(F.col(order).desc(), F.col(key)).limit(n)
    if mode == "random":
        return df.orderBy(seeded_hash(F.col(key), seed=seed), F.col(key)).limit(n)
    raise ValueError(f"unknown mode {mode}")


def replicate_seeds(df: DataFrame, iterations: int, *, base: int = 10) -> DataFrame:
    """Every seed repeated iterations / base times (iterations a multiple of base)."""
    if iterations % base:
        raise ValueError("iterations must be a multiple of base")
    return df.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(iterations // base))))


# ---- equivalence of programs ----------------------------------------------

def output_hash(output: str = "output") -> Column:
    return F.sha2(F.coalesce(F.col(output), F.lit("\u0000null")), 256)


def output_groups(outputs: DataFrame, *, problem: str = "problem_id", tc: str = "tc_no",
                  program: str = "program_id", output: str = "output") -> DataFrame:
    """Programs grouped by identical output per (problem, test).

    One row per group with its size and smallest/largest member; membership is
    the input itself keyed by ``output_hash`` (no list per group is built).
    """
    return (outputs.withColumn("output_hash", output_hash(output))
            .groupBy(problem, tc, "output_hash")
            .agg(F.count(F.lit(1)).alias("n_programs"), F.min(program).alias("min_program"),
                 F.max(program).alias("max_program")))


#: the columns of a signature
SIGNATURE = ("sig_a", "sig_b", "sig_c", "sig_n")


def program_signatures(outputs: DataFrame, *, program: Sequence[str] = ("program_id",),
                       problem: str = "problem_id", tc: str = "tc_no",
                       output: str = "output") -> DataFrame:
    """Signature of each program over all its (problem, test, output) entries.

    Sums of both halves of one 64-bit hash, the XOR of another and the entry
    count: order independent, partially aggregated map-side, never a collected
    list.  Sums do not cancel, so repeated entries count as often as they occur.
    """
    h = output_hash(output)
    return outputs.groupBy(*program).agg(
        F.sum(F.xxhash64(F.col(problem), F.col(tc), h).bitwiseAND(F.lit(0xFFFFFFFF))).alias("sig_a"),
        F.sum(F.shiftrightunsigned(F.xxhash64(F.col(problem), F.col(tc), h), 32)).alias("sig_b"),
        F.bit_xor(F.xxhash64(F.lit("salt"), F.col(tc), F.col(problem), h)).alias("sig_c"),
        F.count(F.lit(1)).alias("sig_n"))


def always_co_located(outputs: DataFrame, *, program: str = "program_id", **kw) -> DataFrame:
    """A10: sets of programs that share an output group in every test.

    Programs with equal signatures form one set; sets of one are dropped.
    Returns one row per member: (cluster_id = smallest member, program).
    """
    sigs = program_signatures(outputs, program=[program], **kw)
    sets = sigs.groupBy(*SIGNATURE).agg(
        F.count(F.lit(1)).alias("n_members"), F.min(program).alias("cluster_id")).filter("n_members > 1")
    return sigs.join(sets, list(SIGNATURE)).select("cluster_id", program, "n_members")


def co_located_sets(outputs: DataFrame, *, program: str = "program_id", **kw) -> DataFrame:
    """A10 summary: one row per set (cluster id, size, largest member)."""
    sigs = program_signatures(outputs, program=[program], **kw)
    return (sigs.groupBy(*SIGNATURE)
            .agg(F.count(F.lit(1)).alias("n_members"), F.min(program).alias("cluster_id"),
                 F.max(program).alias("max_member"))
            .filter("n_members > 1").drop(*SIGNATURE))


def unique_program_count(outputs: DataFrame, *, program: str = "program_id", **kw) -> DataFrame:
    """Total - members of co-located sets + number of sets, and the percentage."""
    sigs = program_signatures(outputs, program=[program], **kw)
    per = sigs.groupBy(*SIGNATURE).agg(F.count(F.lit(1)).alias("m"))
    return per.agg(
        F.sum("m").alias("total_programs"),
        F.count_if(F.col("m") > 1).alias("n_sets"),
        F.sum(F.when(F.col("m") > 1, F.col("m")).otherwise(0)).alias("_in_sets")).select(
        (F.col("total_programs") - F.col("_in_sets") + F.col("n_sets")).alias("unique_programs"),
        "total_programs",
        (100.0 * (F.col("total_programs") - F.col("_in_sets") + F.col("n_sets"))
         / F.col("total_programs")).alias("percent_unique"),
        "n_sets")


# ---- equivalence when programs miss tests or have several outputs of one -----

def _entries(outputs: DataFrame, program: str, problem: str, tc: str, output: str) -> DataFrame:
    return outputs.select(F.col(program).alias("program"), F.xxhash64(F.col(problem), F.col(tc), output_hash(output)).alias("g1"),
                          F.xxhash64(F.lit(7), output_hash(output), F.col(tc), F.col(problem)).alias("g2")).distinct()


def co_location(outputs: DataFrame, *, program: str = "program_id", problem: str = "problem_id", tc: str = "tc_no",
                output: str = "output") -> dict[str, DataFrame]:
    """A10 in general: for each program, the programs that are in every output group it is in.

    A program may miss tests or have several outputs of one.  Programs with the
    same groups are one class; class B belongs to the set of class A if B's groups
    include all of A's.  A class probes only its rarest group for classes with
    more groups than it has, and counts of common groups decide; programs with
    the same number of groups meet in no pair at all.

    Returns ``members`` (class_id = smallest program, program, n_members),
    ``links`` (class_id, other_id, n_other: B's id and size for every A, itself not
    included) and ``sets`` (class_id, n_programs, n_classes) with more than one program.
    """
    entries = materialize(_entries(outputs, program, problem, tc, output), "entries")
    sigs = entries.groupBy("program").agg(F.sum(F.col("g1").bitwiseAND(F.lit(0xFFFFFFFF))).alias("a"), F.sum(F.shiftrightunsigned("g1", 32)).alias("b"),
                                          F.bit_xor("g2").alias("c"), F.count(F.lit(1)).alias("n_groups"))
    same = ["a", "b", "c", "n_groups"]
    classes = sigs.groupBy(*same).agg(F.min("program").alias("class_id"), F.count(F.lit(1)).alias("n_members"))
    members = materialize(sigs.join(classes, same).select("class_id", "program", "n_members", "n_groups"), "co_members")
    classes = members.filter("program = class_id").select("class_id", "n_members", "n_groups")
    held = materialize(entries.join(classes.withColumnRenamed("class_id", "program"), "program").withColumnRenamed("program", "class_id"), "class_entries")
    size = held.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n_in"), F.max("n_groups").alias("_most"))
    # only a group with a class of more groups can lead anywhere
    rarest = held.join(size, ["g1", "g2"]).groupBy("class_id", "n_groups").agg(
        F.min(F.struct("n_in", "g1", "g2")).alias("r"), F.min("_most").alias("_most")).filter("_most > n_groups")
    probe = rarest.select("class_id", F.col("n_groups").alias("_n"), F.col("r.g1").alias("g1"), F.col("r.g2").alias("g2"))
    found = probe.join(held.select("g1", "g2", F.col("class_id").alias("other_id"), F.col("n_members").alias("n_other"), F.col("n_groups").alias("_m")),
                       ["g1", "g2"]).filter("_m > _n").select("class_id", "_n", "other_id", "n_other")
    common = found.join(held.select("class_id", "g1", "g2"), "class_id").join(
        held.select(F.col("class_id").alias("other_id"), "g1", "g2"), ["other_id", "g1", "g2"])
    links = common.groupBy("class_id", "other_id", "n_other", "_n").agg(F.count(F.lit(1)).alias("_common")).filter("_common = _n")
    links = materialize(links.select("class_id", "other_id", "n_other"), "co_links")
    more = links.groupBy("class_id").agg(F.sum("n_other").alias("_others"), F.count(F.lit(1)).alias("_n_others"))
    sets = classes.join(more, "class_id", "left").select(
        "class_id", (F.col("n_members") + F.coalesce("_others", F.lit(0))).alias("n_programs"), (F.coalesce("_n_others", F.lit(0)) + 1).alias("n_classes"))
    return {"members": members.drop("n_groups").withColumnRenamed("program", program), "links": links, "sets": sets.filter("n_programs > 1")}


def unique_program_count_general(outputs: DataFrame, **kw) -> DataFrame:
    """A11 over ``co_location``: total - programs in any set of several + number of such sets."""
    found = co_location(outputs, **kw)
    sets, links = found["sets"].select("class_id"), found["links"]
    inside = sets.unionByName(links.select(F.col("other_id").alias("class_id"))).distinct()
    sizes = found["members"].groupBy("class_id").agg(F.max("n_members").alias("m"))
    total = sizes.join(inside.withColumn("inside", F.lit(True)), "class_id", "left").agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("total_programs"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("m"))), F.lit(0)).alias("_in_sets"))
    both = side_by_side(total, sets.agg(F.count(F.lit(1)).alias("n_sets")))
    unique = F.col("total_programs") - F.col("_in_sets") + F.col("n_sets")
    return both.select(unique.alias("unique_programs"), "total_programs", safe_divide(100.0 * unique, F.col("total_programs")).alias("percent_unique"), "n_sets")


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key under an explicit order (not dropDuplicates)."""
    return keep_first(df, keys, order)


def keep_one_per_cluster(outputs: DataFrame, *, program: str = "program_id", **kw) -> DataFrame:
    """W6 on clusters: the surviving program of every equivalence class (its
    smallest id); programs in no shared set survive as themselves."""
    sigs = program_signatures(outputs, program=[program], **kw)
    return sigs.groupBy(*SIGNATURE).agg(
        F.min(program).alias(program), F.count(F.lit(1)).alias("n_equivalent"))


def assign_ids(df: DataFrame, *, order: Sequence[str], prefix: str = "generated_",
               name: str = "gen_id") -> DataFrame:
    """Ids prefix_0..prefix_{n-1} in ``order`` (per-partition counts + offsets)."""
    return dense_index(df, order, name="_i").withColumn(
        name, F.concat(F.lit(prefix), F.col("_i").cast("string"))).drop("_i")


# ---- novelty -----------------------------------------------------------------

def _on_tests(outputs: DataFrame, chosen: DataFrame, problem: str, tc: str, program: str, output: str) -> DataFrame:
    """Signatures over the chosen tests (a ``small`` table) of programs that have an output for every one of them.

    Few tests have the outputs of all programs: those stay where they are and add up
    there, before anything is shuffled.
    """
    n = small(chosen.groupBy(problem).agg(F.count(F.lit(1)).alias("_n_chosen")), "n_chosen")
    kept = outputs.filter(F.col(output).isNotNull()).join(chosen, [problem, tc], "left_semi")
    sigs = program_signatures(kept, program=[problem, program], problem=problem, tc=tc, output=output)
    return sigs.join(n, problem).filter("sig_n = _n_chosen").drop("_n_chosen")


def match_classes(cands: DataFrame, refs: DataFrame, tests: DataFrame, *,
                  problem: str = "problem_id", tc: str = "tc_no", program: str = "program_id",
                  output: str = "output") -> DataFrame:
    """J8 in full: which references each candidate agrees with on all chosen tests.

    Programs of one problem with equal outputs on every chosen test form a
    class, named by its smallest reference.  One row per program of a class that
    has a reference: (problem, class_id, is_reference, program); the references
    of a candidate's class are its matches, without a row for every pair.
    """
    chosen = small(tests.select(problem, tc).distinct(), "chosen_tests")
    c = _on_tests(cands, chosen, problem, tc, program, output).withColumn("is_reference", F.lit(False))
    r = _on_tests(refs, chosen, problem, tc, program, output).withColumn("is_reference", F.lit(True))
    ids = r.groupBy(problem, *SIGNATURE).agg(F.min(program).alias("class_id"))
    return c.unionByName(r).join(ids, [problem, *SIGNATURE]).select(problem, "class_id", "is_reference", program)


def match_outputs(cands: DataFrame, refs: DataFrame, tests: DataFrame, *,
                  problem: str = "problem_id", tc: str = "tc_no", program: str = "program_id",
                  output: str = "output") -> DataFrame:
    """How many reference programs agree with each candidate on *all* chosen tests of its problem.

    Only programs with an output for every chosen test can agree (a NULL output
    is none).  Signatures over the chosen tests replace the candidate x
    reference join; ``class_id`` leads to the matching references (``match_classes``).
    """
    chosen = small(tests.select(problem, tc).distinct(), "chosen_tests")
    c = _on_tests(cands, chosen, problem, tc, program, output)
    r = _on_tests(refs, chosen, problem, tc, program, output)
    rc = r.groupBy(problem, *SIGNATURE).agg(F.count(F.lit(1)).alias("n_matching"), F.min(program).alias("class_id"))
    found = c.join(rc, [problem, *SIGNATURE]).select(problem, program, "n_matching", "class_id")
    return (cands.select(problem, program).distinct().join(found, [problem, program], "left")
            .select(problem, program, F.coalesce("n_matching", F.lit(0)).alias("n_matching"), "class_id"))


def novelty_filter(cands: DataFrame, refs: DataFrame, all_tests: DataFrame, *, last_n: int = 20,
                   problem: str = "problem_id", tc: str = "tc_no", program: str = "program_id",
                   output: str = "output") -> DataFrame:
    """A candidate is novel when it ran on all tests of its problem and no
    reference program agrees with it on all of the ``last_n`` highest tests.

    A test without an output, with a NULL one or with a timeout/error was not run.
    """
    every = small(all_tests.select(problem, tc).distinct(), "every_test")
    n_tests = small(every.groupBy(problem).agg(F.count(F.lit(1)).alias("_n_tests")), "n_tests")
    done = F.when(F.col(output).isNotNull() & ~F.col(output).isin(*RUN_FAILURES), F.col(tc))
    ran = cands.join(every, [problem, tc], "left_semi").groupBy(problem, program, tc).agg(F.count(done).alias("_done")).groupBy(
        problem, program).agg(F.count_if(F.col("_done") > 0).alias("_n_run"))
    chosen = top_tests(every, n=last_n, group=problem, tc=tc)
    m = match_outputs(cands, refs, chosen, problem=problem, tc=tc, program=program, output=output)
    runs_all = F.coalesce(F.col("_n_run") == F.col("_n_tests"), F.lit(False))
    return (m.join(ran, [problem, program], "left").join(n_tests, problem, "left").select(
        problem, program, runs_all.alias("runs_all"), "n_matching", (runs_all & (F.col("n_matching") == 0)).alias("is_different")))


# ---- prompts, cost -----------------------------------------------------------

# Self-play prompt templates with numbered slots.
CODE_ONLY_TEMPLATE = """
Description 1: ...
Code 1: ...
Description 2: ...
Code 2: ...
Now, can you generate a program that takes that same input as Code 2 in Code 3 but produces different outputs? Write it to be as novel as possible. 
Code 3: """

CODE_DESCRIPTION_PAIR_START_TEMPLATE = """
Description 1: ...
Code 1: ...
Description 2: ...
Code 2: ...
Now, can you generate a description for a new problem. It must take input from Description 2/Code 2 but will produce a different output than Code 2. Write it to be as different as novel as possible. Do not solve it yet.
Description 3:"""

CODE_DESCRIPTION_PAIR_END_TEMPLATE = """
Now, can you generate a program that solves Description 3? Write it to be as novel as possible and remember it needs to produce a different output than Code 2. 
Code 3:"""


# what a slot of each kind takes from its column: programs lose runs of
# newlines, descriptions lose tags and longer runs; a missing one is empty
_CLEAN = {
    "Code": lambda c: canonical_newlines(c, 1),
    "Description": lambda c: canonical_newlines(F.regexp_replace(c, r"<[^>]*>", ""), 2),
}
_NUMBERED_SLOT = re.compile(r"(Code|Description) (\d+): \.\.\.")


def continue_prompts(prompts: DataFrame, completions: DataFrame, *, key: str = "request_id", prompt: str = "prompt",
                     completion: str = "description", end: str = CODE_DESCRIPTION_PAIR_END_TEMPLATE, sentinel: str = FAILED_COMPLETION,
                     out: str = "next_prompt") -> DataFrame:
    """F5, second step: a prompt, the completion it got, and the end template as the next prompt.

    Completions are joined back by key (J5).  Each part is followed by a blank
    line.  A failed first step (no completion, NULL or the sentinel) ends the chain:
    ``failed`` is true and there is no next prompt; neither is there one for a row
    without a prompt.
    """
    d = prompts.join(completions.select(key, completion), key, "left")
    failed = F.col(completion).isNull() | (F.col(completion) == F.lit(sentinel))
    step = F.concat(F.col(prompt), F.col(completion), F.lit("\n\n"), F.lit(end), F.lit("\n\n"))
    return d.withColumn("failed", failed).withColumn(out, F.when(~F.col("failed"), step))


def fill_prompt_slots(pairs: DataFrame, template: str = CODE_ONLY_TEMPLATE, *,
                      slots: Mapping[str, str] | None = None, out: str = "prompt") -> DataFrame:
    """every numbered slot of the template gets its cleaned column and a blank line.

    ``slots`` names the column of each slot (default: the candidate in slot 2,
    its partner in slot 1); a slot without a column stays as it is, and a row
    without a partner has no prompt (NULL).
    """
    columns = slots or {"Code 2": "cand_code", "Description 2": "cand_desc", "Code 1": "partner_code", "Description 1": "partner_desc"}
    pieces, at = [], 0
    for m in _NUMBERED_SLOT.finditer(template):
        column = columns.get(f"{m[1]} {m[2]}")
        if column is None:
            continue
        pieces += [F.lit(f"{template[at:m.start()]}{m[1]} {m[2]}: "), F.coalesce(_CLEAN[m[1]](F.col(column)), F.lit("")), F.lit("\n\n")]
        at = m.end()
    prompt = F.concat(*pieces, F.lit(template[at:]))
    if "partner_id" in pairs.columns:
        prompt = F.when(F.col("partner_id").isNotNull(), prompt)
    return pairs.withColumn(out, prompt)


def sample_context_pairs(cands: DataFrame, pool: DataFrame, *, max_len: int, draws: int = 25,
                         seed: int = 0, key: str = "problem_id", length: str = "total_length",
                         desc_length: str = "text_description_length") -> DataFrame:
    """A random partner for every candidate under a length budget.

    Draws d = 0..draws-1 pick the pool row ranked ``hash(seed, candidate, d) mod
    |pool|`` (ids of any type); the earliest accepted draw wins (total length within ``max_len``
    and the partner has a description).  The partner may be the candidate
    itself.  No accepted draw gives NULL partner columns.  An equi join on the
    drawn rank, never a theta join of candidates x pool.
    """
    # The pool is read by the range sampler, the size count and the join, and
    # the candidates twice: write both narrow projections once instead of
    # recomputing their (possibly text-heavy) lineage each time.
    same = cands is pool
    pool = materialize(pool.select(key, length, desc_length), "pairing_pool")
    cands = (pool if same else materialize(cands.select(key, length), "pairing_candidates")).select(
        F.col(key).alias("candidate_id"), F.col(length).alias("_clen"))
    n = pool.count()
    if n == 0:
        return cands.select("candidate_id", F.lit(None).cast("int").alias("draw"),
                            F.lit(None).cast(pool.schema[key].dataType).alias("partner_id"))
    ranked = dense_index(pool, [key], name="_rank")
    tried = cands.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    tried = tried.withColumn("_rank", F.pmod(seeded_hash(F.col("candidate_id"), F.col("draw"), seed=seed), F.lit(n)))
    hit = (tried.join(ranked.withColumnRenamed(key, "partner_id"), "_rank")
           .filter((F.col("_clen") + F.col(length) <= max_len) & (F.col(desc_length) > 0)))
    first = keep_first(hit.select("candidate_id", "draw", "partner_id"), ["candidate_id"], ["draw"])
    return cands.select("candidate_id").join(first, "candidate_id", "left")


def drop_failed_completions(df: DataFrame, *, code: str = "code",
                            sentinel: str = FAILED_COMPLETION) -> DataFrame:
    """mark failed completions (NULL or the sentinel); they stay, cost
    nothing and are never novel."""
    failed = F.col(code).isNull() | (F.col(code) == F.lit(sentinel))
    return df.withColumn("failed", failed)


def cost_report(completions: DataFrame, *, request: str = "request_id", template: str = "template",
                code: str = "code", prompt_rate: float = PROMPT_RATE_PER_1K,
                completion_rate: float = COMPLETION_RATE_PER_1K, tokenizer=None) -> DataFrame:
    """Cost per completion.  The prompt cost of a request is split over its
    successful completions; a failed completion costs nothing."""
    d = drop_failed_completions(completions, code=code)
    per_req = d.groupBy(request).agg(
        F.count_if(~F.col("failed")).alias("n_successful"),
        F.first(template, ignorenulls=True).alias("_tpl"))
    per_req = per_req.withColumn("template_len", token_length(F.col("_tpl"), tokenizer)).drop("_tpl")
    out = d.join(per_req, request)
    tcost = F.col("template_len") * F.lit(prompt_rate) / 1000.0
    gen_len = F.when(F.col("failed"), F.lit(0)).otherwise(token_length(F.col(code), tokenizer))
    return (out.withColumn("generation_len", gen_len)
            .withColumn("generation_cost", F.col("generation_len") * F.lit(completion_rate) / 1000.0)
            .withColumn("total_cost", F.when(F.col("failed"), F.lit(0.0)).otherwise(
                F.col("generation_cost") + F.coalesce(safe_divide(tcost, F.col("n_successful")), F.lit(0.0)))))


def cost_summary(costs: DataFrame, unique_programs: Column | None = None) -> DataFrame:
    """A16 totals: total cost, average template/generation length, cost per unique program."""
    out = costs.agg(F.sum("total_cost").alias("total_cost"),
                    F.avg("template_len").alias("avg_template_len"),
                    F.avg("generation_len").alias("avg_generation_len"))
    if unique_programs is not None:
        out = out.withColumn("cost_per_unique", safe_divide(F.col("total_cost"), unique_programs))
    return out


def short_description_report(desc: DataFrame, *, text: str = "text_description",
                             min_tokens: int = 25, tokenizer=None) -> DataFrame:
    """Flag descriptions shorter than ``min_tokens`` (rows are kept)."""
    n = token_length(F.col(text), tokenizer)
    return desc.withColumn("n_tokens", n).withColumn("is_short", F.col("n_tokens") < min_tokens)


def projected_cost(params: DataFrame, *, calls: str = "n_calls", prompt_tokens: str = "prompt_tokens",
                   answer_tokens: str = "answer_tokens", answers: str = "answers_per_call",
                   prompt_rate: float = PROMPT_RATE_PER_1K, completion_rate: float = COMPLETION_RATE_PER_1K) -> DataFrame:
    """the budget of each row of request parameters.

    A call costs its prompt tokens once and the tokens of each of its answers,
    both at their rate per 1000.
    """
    per_call = F.col(prompt_tokens) * F.lit(prompt_rate) + F.col(answer_tokens) * F.lit(completion_rate) * F.col(answers)
    return params.withColumn("projected_cost", F.col(calls) * per_call / 1000.0)
