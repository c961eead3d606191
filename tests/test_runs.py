import pytest
from pyspark.sql import functions as F

from pairlab.operators import runs as rn

# golden simulated times per test (two programs, two tests)
A = (0.001035073468, 0.001039205596)
B = (0.001026564396, 0.001029346032)


@pytest.mark.parametrize("out,exp,acc", [
    ("1\n2.0004\n", "1\n2.0\n", 1.0),
    ("1", "1\n2", 0.5),
    ("1\n2\n3", "1\n2", 1.0),
    ("1d", "1", 0.0),
    ("  x  ", "x", 1.0),
    ("", "1", 0.0),
    ("1", "", None),
])
def test_output_accuracy(spark, out, exp, acc):
    got = spark.range(1).select(rn.output_accuracy(F.lit(out), F.lit(exp)).alias("a")).first()["a"]
    assert got == acc


def test_pair_totals_and_speedup_golden(spark):
    rows = [(1, tc, True, t, "v0") for tc, t in enumerate(A)] + [(1, tc, True, t, "v1") for tc, t in enumerate(B)]
    df = spark.createDataFrame(rows, "submission_id long, tc int, success boolean, t double, v string")
    out = rn.pair_versions(df.filter("v = 'v0'"), df.filter("v = 'v1'")).first()
    assert out["agg_runtime_v0"] == pytest.approx(0.002074279064, abs=1e-15)
    assert out["agg_runtime_v1"] == pytest.approx(0.002055910428, abs=1e-15)
    assert out["speedup"] == pytest.approx(1.00893, abs=1e-5)


def test_total_runtime_failure_is_inf(spark):
    df = spark.createDataFrame([(1, 0, True, 1.0), (1, 1, False, None), (2, 0, True, 2.0)],
                               "submission_id long, tc_no int, success boolean, t double")
    got = {r["submission_id"]: r["agg_runtime"] for r in rn.total_runtime(df).collect()}
    assert got == {1: float("inf"), 2: 2.0}


def test_fail_fast_marks_later_tests(spark):
    df = spark.createDataFrame([(1, 1, True, 1.0), (1, 2, False, 2.0), (1, 3, True, 3.0), (2, 1, True, 1.0)],
                               "submission_id long, seq int, success boolean, t double")
    rows = {(r["submission_id"], r["seq"]): r for r in rn.fail_fast(df).collect()}
    assert rows[(1, 3)]["skipped"] and rows[(1, 3)]["t"] is None and not rows[(1, 3)]["success"]
    assert rows[(1, 3)]["error"] == rn.SKIPPED_MESSAGE
    assert not rows[(1, 2)]["skipped"] and not rows[(2, 1)]["skipped"]
    off = rn.fail_fast(df, enabled=False).filter("skipped").count()
    assert off == 0


def test_fail_fast_blocks_match_single_block(spark):
    from pairlab.operators.scan import prefix_agg
    df = spark.createDataFrame([(1, i, i % 7 == 5) for i in range(1, 40)], "k long, seq int, bad boolean")
    small = prefix_agg(df, ["k"], "seq", [("m", "max", F.col("bad").cast("int"), False)], block_size=4)
    big = prefix_agg(df, ["k"], "seq", [("m", "max", F.col("bad").cast("int"), False)], block_size=1 << 20)
    assert sorted(small.collect()) == sorted(big.collect())


def test_aligned_repeats(spark):
    rows = [(1, "a", 0, 1.0), (1, "a", 1, 3.0), (1, "a", 2, 100.0), (1, "b", 0, 1.0), (1, "b", 1, 1.0),
            (2, "a", 0, 1.0), (2, "b", 0, None)]
    df = spark.createDataFrame(rows, "submission_id long, tc string, rep int, t double")
    got = {r["submission_id"]: r for r in rn.aligned_repeat_stats(df).collect()}
    assert got[1]["shortest"] == 2 and got[1]["agg_runtime"] == 3.0 and got[1]["agg_stdev"] == 1.0
    assert got[2]["agg_runtime"] == float("inf")


def test_accuracy_gate_is_strict(spark):
    df = spark.createDataFrame([(0.95, 1.0), (0.9499, 1.0), (None, 1.0)], "mean_acc double, agg_runtime double")
    got = [r["agg_runtime"] for r in rn.accuracy_gate(df).collect()]
    assert got == [1.0, float("inf"), float("inf")]


def test_parse_run_stats(spark):
    text = ["---------- Begin Simulation Statistics ----------",
            "sim_ticks 1035073468 # Number of ticks",
            "sim_freq 1000000000000 # frequency",
            "", "host_pct 12.5% # share", "bad nan", "multi 1 2 3", "lonely",
            "---------- End Simulation Statistics   ----------"]
    df = spark.createDataFrame([(7, t) for t in text], "run_id long, line string")
    got = {r["stat"]: r["values"] for r in rn.parse_run_stats(df).collect()}
    assert got["host_pct"] == [12.5] and got["bad"] == [None] and got["multi"] == [1.0, 2.0, 3.0]
    assert "lonely" not in got
    assert got["sim_seconds_precise"][0] == pytest.approx(0.001035073468, abs=1e-18)


def test_total_runtime_maps_on_request(spark):
    df = spark.createDataFrame([(1, 0, True, 1.0), (1, 1, False, None)],
                               "submission_id long, tc_no int, success boolean, t double")
    r = rn.total_runtime(df, map_limit=10).first()
    assert r["tc2time"] == {0: 1.0, 1: float("inf")} and r["tc2success"] == {0: True, 1: False}
