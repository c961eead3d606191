"""Numbering, seeded draws, novelty with holes, signatures, gaps and string ids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.functions.text import cut_after_main, seeded_hash
from pairlab.operators import augment as au
from pairlab.operators import evaluate as ev
from pairlab.operators import prepare as pp
from pairlab.operators import reshape as rs
from pairlab.operators import retrieve as rt
from pairlab.operators import runs as rn
from pairlab.operators.scan import dense_index, keep_first
from pairlab.sources import io

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("partitions", [16, 200])
def test_numbering_with_a_payload_is_dense(spark, partitions):
    d = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = dense_index(d, ["k", "id"], num_partitions=partitions)
    got = out.agg(F.count("idx"), F.countDistinct("idx"), F.min("idx"), F.max("idx")).first()
    assert tuple(got) == (200_000, 200_000, 0, 199_999)
    previous = out.select(F.col("idx") - 1, F.col("k").alias("pk"), F.col("id").alias("pid")).toDF("idx", "nk", "nid")
    assert out.join(previous, "idx").filter("nk < k OR (nk = k AND nid <= id)").count() == 0


def test_shuffles_differ_by_seed_and_do_not_follow_ids(spark):
    d = spark.range(2000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("k"), "id")
    one, two = ([r["id"] for r in pp.shuffle_head(d, key="k", seed=s).collect()] for s in (42, 7))
    assert one != two and sorted(one) == sorted(two) == list(range(2000))
    for order in (one, two):
        assert abs(np.corrcoef(order, np.arange(2000))[0, 1]) < 0.08
    assert abs(np.corrcoef(np.argsort(one), np.argsort(two))[0, 1]) < 0.08
    seeds = d.withColumnRenamed("k", "problem_id").withColumn("n_accepted", F.lit(1))
    picks = [{r["problem_id"] for r in au.sample_candidates(seeds, 50, mode="random", seed=s).collect()} for s in (1, 99)]
    assert len(picks[0] & picks[1]) < 15


def test_draws_are_uniform_over_the_pool(spark):
    d = spark.range(400).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(24))))
    ranks = [r[0] for r in d.select(F.pmod(seeded_hash("id", "draw", seed=3), F.lit(100))).collect()]
    counts = np.bincount(ranks, minlength=100)
    assert ((counts - 100) ** 2 / 100).sum() < 150  # chi-square, 99 degrees of freedom
    first = np.array(ranks).reshape(400, 25)
    assert np.mean(np.diff(np.sort(first, axis=1), axis=1) == 1) < 0.3  # not consecutive ranks


OUT = "problem_id long, tc_no int, program_id string, output string"


def test_novelty_needs_every_test(spark):
    refs = spark.createDataFrame([(1, t, "r", "x") for t in range(5)] + [(2, t, "r", "x") for t in range(5)], OUT)
    cands = spark.createDataFrame([(1, t, "skips", "y") for t in range(2)] + [(1, t, "null", None if t == 4 else "y") for t in range(5)]
                                  + [(1, t, "new", "y") for t in range(5)] + [(2, t, "new", "x") for t in range(5)] + [(1, 0, "twice", "y"), (1, 0, "twice", "y")], OUT)
    got = {(r["problem_id"], r["program_id"]): (r["runs_all"], r["n_matching"], r["is_different"])
           for r in au.novelty_filter(cands, refs, refs.select("problem_id", "tc_no")).collect()}
    assert got == {(1, "skips"): (False, 0, False), (1, "null"): (False, 0, False), (1, "new"): (True, 0, True), (2, "new"): (True, 1, False), (1, "twice"): (False, 0, False)}
    from pairlab.plans.jobs import select_novel
    both = cands.withColumn("kind", F.lit("candidate")).unionByName(refs.withColumn("kind", F.lit("reference")))
    groups = select_novel(both)["groups"].select("problem_id").distinct().collect()
    assert [r["problem_id"] for r in groups] == [1]  # novel for problem 1 only


def test_repeated_entries_do_not_cancel(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 1, "a", "y"), (1, 0, "b", "z"), (1, 0, "b", "z"), (1, 1, "b", "y")]
    assert au.always_co_located(spark.createDataFrame(rows, OUT)).count() == 0


def test_gaps_carry_the_last_answer(spark):
    schema = "src_id long, problem_id long, src_runtime double, tgt_runtime double, gen_idx int, code string, accuracy double, agg_runtime double"
    rows = [(1, 1, 8.0, 1.0, 0, "a", 1.0, 4.0), (1, 1, 8.0, 1.0, 2, "b", 1.0, 2.0)] + [(2, 1, 8.0, 1.0, k, "c", 1.0, 8.0) for k in range(3)] + [(3, 1, 8.0, 1.0, 1, "d", 0.5, 1.0)]
    df = spark.createDataFrame(rows, schema)
    for size in (1, 2, 1 << 14):
        got = {r["k"]: (r["n_inputs"], r["mean_speedup"]) for r in ev.best_at_k_summary(ev.best_at_k(df, block_size=size), block_size=size).collect()}
        assert got == {1: (2, 1.5), 2: (3, pytest.approx(4 / 3)), 3: (3, 2.0)}


def test_keep_first_carries_maps_and_nulls(spark):
    df = spark.createDataFrame([(1, None, {"a": 1}), (1, 2.0, {"b": 2}), (None, 1.0, {"c": 3})], "k long, o double, m map<string,int>")
    assert {(r["k"], r["o"], str(r["m"])) for r in keep_first(df, ["k"], ["o"]).collect()} == {(1, 2.0, "{'b': 2}"), (None, 1.0, "{'c': 3}")}


def test_knn_string_ids_null_vectors_and_ties(spark):
    e = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [1.0]), ("d", None), ("e", [5.0])], "id string, embedding array<double>")
    got = rt.knn_join(e.withColumnRenamed("id", "query_id"), e.withColumnRenamed("id", "neighbor_id"), k=2, qkey="query_id", ckey="neighbor_id", corpus_partitions=2)
    rows = {(r["query_id"], r["rank"]): r["neighbor_id"] for r in got.collect()}
    assert rows == {("a", 1): "b", ("a", 2): "c", ("b", 1): "c", ("b", 2): "a", ("c", 1): "b", ("c", 2): "a", ("e", 1): "b", ("e", 2): "c"}


def test_performance_tag_of_a_runtime_of_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 2.0)], "problem_id long, agg_runtime double")
    assert sorted(r["pctile"] for r in pp.performance_tag(df).collect()) == ["1", "10"]


def test_plain_answers_and_unparsable_lists(spark):
    df = spark.createDataFrame([("['a', 'b']",), ("plain",), ("[None, 'x']",), ("[oops",), ("[oops(]",), (None,), ("",)], "a string")
    assert [r["a"] for r in rs.parse_list_literal(df, ["a"]).collect()] == [["a", "b"], ["plain"], [None, "x"], ["[oops"], None, None, [""]]


def test_missing_slots_are_empty_and_missing_partners_have_no_prompt(spark):
    df = spark.createDataFrame([(1, 2, "c\n\n\nd", None, "p", "<b>q</b>"), (2, None, "c", "d", None, None)],
                               "candidate_id long, partner_id long, cand_code string, cand_desc string, partner_code string, partner_desc string")
    one, two = (r["prompt"] for r in au.fill_prompt_slots(df).orderBy("candidate_id").collect())
    assert "Code 2: c\nd\n\n" in one and "Description 2: \n\n" in one and "Description 1: q\n\n" in one and "..." not in one
    assert two is None


def test_seeds_without_a_cut(spark):
    df = spark.createDataFrame([(1, i, float(20 - i)) for i in range(15)], "problem_id long, submission_id long, agg_runtime double")
    passed = spark.createDataFrame([(1, 2, True)], "problem_id long, submission_id long, passed boolean")
    assert au.fastest_correct(df, passed, program="submission_id").collect() == []  # ranks 13th
    best = au.fastest_correct(df, passed, program="submission_id", top=None).first()
    assert (best["submission_id"], best["num_submissions"], best["n_accepted"]) == (2, 15, 15)


def test_required_columns_are_looked_for_in_the_files(spark, tmpdir_fresh):
    import os
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    for name, line in (("x", '{"a": 1, "b": null}'), ("y", '{"a": 1}')):
        os.makedirs(f"{tmpdir_fresh}/{name}")
        open(f"{tmpdir_fresh}/{name}/f.jsonl", "w").write(line + "\n")
    assert io.read_records(spark, f"{tmpdir_fresh}/x", schema, required=["a", "b"]).count() == 1
    with pytest.raises(ValueError):
        io.read_records(spark, f"{tmpdir_fresh}/*", schema, required=["b"])


def test_nested_infinities_are_written_as_null(spark, tmpdir_fresh):
    df = spark.sql("SELECT array(CAST('inf' AS DOUBLE), 1.0D) AS a, named_struct('x', CAST('nan' AS DOUBLE)) AS s, map('k', CAST('-inf' AS DOUBLE)) AS m")
    io.write_records(df, f"{tmpdir_fresh}/n", inf_as_null=True)
    back = io.read_records(spark, f"{tmpdir_fresh}/n", df.schema).first()
    assert back["a"] == [None, 1.0] and back["s"] is None or back["s"]["x"] is None


def test_a_success_without_a_time_is_no_time(spark):
    df = spark.createDataFrame([(1, 0, True, None), (1, 1, True, 1.0)], "submission_id long, tc_no int, success boolean, t double")
    assert rn.total_runtime(df).first()["agg_runtime"] == math.inf


def test_the_last_line_of_a_stat_counts_and_filters_work(spark):
    lines = spark.createDataFrame([(7, i, t) for i, t in enumerate(["sim_ticks 1", "sim_ticks 4", "sim_freq 2", "name abc"])], "run_id long, at int, line string")
    d = rn.parse_run_stats(lines, ordinal="at")
    got = {r["stat"]: (r["values"], r["texts"]) for r in d.collect()}
    assert got["sim_ticks"] == ([4.0], ["4"]) and got["name"] == ([None], ["abc"]) and got["sim_seconds_precise"][0] == [2.0]
    assert d.filter("get(values, 0) > 3").count() == 1


@pytest.mark.parametrize("text,want", [("x main() { a { b } c } rest", "x main() { a { b } c }"), ("main } { x } y", "main } { x } y"), ("main } } { { } } }", "main } } { { } } }"),
                                       ("no program", "no program"), ("main { never", "main { never"), ("remain {}", "remain {}"), (None, None), ("", "")])
def test_cut_after_main(text, want):
    assert cut_after_main(text) == want
