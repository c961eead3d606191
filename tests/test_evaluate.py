import math


from pairlab.operators import evaluate as ev

SCHEMA = "src_id long, problem_id long, src_runtime double, tgt_runtime double, gen_idx int, code string, accuracy double, agg_runtime double"


def gens(spark):
    rows = [
        # input 1: three answers; the second is the fastest correct one
        (1, 10, 10.0, 5.0, 0, "a", 1.0, 8.0), (1, 10, 10.0, 5.0, 1, "b", 1.0, 2.0), (1, 10, 10.0, 5.0, 2, "c", 0.5, 1.0),
        # input 2: one missing answer then one too slow answer (ragged: 2 answers)
        (2, 10, 4.0, 4.0, 0, None, None, None), (2, 10, 4.0, 4.0, 1, "d", 1.0, 8.0),
        # input 3: only wrong answers
        (3, 20, 6.0, 0.0, 0, "e", 0.2, 1.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_best_at_k_rows(spark):
    got = {(r["src_id"], r["k"]): r for r in ev.best_at_k(gens(spark)).collect()}
    assert got[(1, 1)]["best_runtime"] == 8.0 and got[(1, 2)]["best_runtime"] == 2.0
    assert got[(1, 3)]["best_runtime"] == 2.0  # below-threshold answer does not count
    assert got[(1, 3)]["speedup"] == 5.0
    assert got[(2, 1)]["best_runtime"] == math.inf and got[(2, 1)]["best_accuracy"] is None
    assert got[(2, 2)]["speedup"] == 1.0  # floored
    assert not got[(3, 1)]["is_correct"] and got[(3, 1)]["is_last"]


def test_summary_carries_short_lists_forward(spark):
    s = {r["k"]: r for r in ev.best_at_k_summary(ev.best_at_k(gens(spark))).collect()}
    assert sorted(s) == [1, 2, 3]
    assert all(r["n_inputs"] == 3 for r in s.values())
    # k=3: input1 speedup 5, input2 carries 1.0, input3 carries 1.0
    assert abs(s[3]["mean_speedup"] - 7.0 / 3) < 1e-12
    # accuracy mean skips inputs whose best accuracy is still missing
    assert s[1]["mean_accuracy"] == (1.0 + 0.2) / 2
    assert s[3]["share_correct"] == 2 / 3
    # monotone in k
    assert s[1]["mean_speedup"] <= s[2]["mean_speedup"] <= s[3]["mean_speedup"]


def test_speedup_shares_monotone_in_threshold(spark):
    long = ev.shares_long(ev.best_at_k_summary(ev.best_at_k(gens(spark))), ["k"]).filter("k = 3")
    shares = [r["share"] for r in long.orderBy("threshold").collect()]
    assert shares == sorted(shares, reverse=True)


def test_group_best_and_reference(spark):
    best = ev.best_at_k(gens(spark), keep=["problem_id"]).filter("is_last")
    g = {r["src_id"]: r for r in ev.group_best(best).collect()}
    assert g[2]["group_best"] == 2.0 and g[2]["group_speedup"] == 2.0 and g[3]["group_correct"] is False
    ref = ev.reference_speedup(gens(spark).select("src_id", "src_runtime", "tgt_runtime").distinct()).first()
    # input 3 has tgt 0 -> inf speedup, which reaches every threshold
    assert ref["n_inputs"] == 3 and ref["share_ge_1_1"] == 2 / 3


def test_complete_with_missing_row_arithmetic(spark):
    g = gens(spark)
    inputs = spark.createDataFrame([(i, 10, 1.0, 1.0) for i in range(1, 6)] + [(5, 10, 1.0, 1.0)],
                                   "src_id long, problem_id long, src_runtime double, tgt_runtime double")
    out = ev.complete_with_missing(g, inputs, key=["src_id"],
                                   fill={"gen_idx": 0, "accuracy": 0.0, "agg_runtime": float("inf")},
                                   expected_rows=5)
    filled = out.filter("is_filled")
    assert filled.count() == 2  # inputs 4 and 5 (5 deduplicated)
    assert out.count() == g.count() + 2
    r = filled.orderBy("src_id").first()
    assert r["accuracy"] == 0.0 and r["agg_runtime"] == math.inf and r["code"] is None


def test_drop_identity_pairs(spark):
    df = spark.createDataFrame([(1, " a ", " a "), (2, " a", "b"), (3, None, "b")], "src_id long, src_code string, tgt_code string")
    out = {r["src_id"]: r["slower_program"] for r in ev.drop_identity_pairs(df).collect()}
    assert out == {2: "a", 3: None}


def test_summary_blocks_equal_one_block(spark):
    best = ev.best_at_k(gens(spark))
    a = sorted(tuple(r) for r in ev.best_at_k_summary(best).collect())
    b = sorted(tuple(r) for r in ev.best_at_k_summary(best, block_size=1).collect())
    assert a == b


def test_best_at_k_small_blocks_equal_one_block(spark):
    rows = [(7, 1, 50.0, 50.0, i, "c", 1.0 if i % 4 else 0.5, float(100 - i)) for i in range(40)]
    g = spark.createDataFrame(rows, SCHEMA)
    small = sorted(tuple(r) for r in ev.best_at_k(g, block_size=3).collect())
    big = sorted(tuple(r) for r in ev.best_at_k(g).collect())
    assert small == big
