"""Counts and checks inside plans, general co-location, version comparison, evaluation with infinities."""

import collections

import pytest

from pairlab.operators import augment as au
from pairlab.operators import checks as ck
from pairlab.operators import evaluate as ev
from pairlab.operators import runs as rn

INF = float("inf")


def test_identity_pairs_counted_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([("a", "a"), (" b ", "c"), (None, "d")], "src_code string, tgt_code string")
    done = ck.drop_identity_pairs(df)
    assert done.write(f"{tmp_path}/a") == {"n_pairs": 3, "n_identical": 1}
    assert sorted(map(str, (r.slower_program for r in spark.read.parquet(f"{tmp_path}/a").collect()))) == ["None", "b"]
    with pytest.raises(ck.CheckFailed, match="no pair is left"):
        ck.drop_identity_pairs(df.filter("src_code = 'a'")).write(f"{tmp_path}/b")


def test_clean_code_and_failed_completions(spark):
    df = spark.createDataFrame([("x",), ("",), (None,), (" ",), (au.FAILED_COMPLETION,)], "code string")
    done = ck.clean_code_rows(df, most_dropped=0.3)
    assert len(done.rows.collect()) == 3 and done.counts() == {"n_rows": 5, "n_null": 1, "n_empty": 1}
    with pytest.raises(ck.CheckFailed, match="30%"):
        done.verify()
    failed = ck.drop_failed_completions(df)
    assert sum(r.failed for r in failed.rows.collect()) == 2 and failed.verify()["n_failed"] == 2


def test_completion_arithmetic(spark):
    ref = spark.createDataFrame([(1, "r1"), (2, "r2"), (2, "r2"), (3, "r3")], "k long, name string")
    res = spark.createDataFrame([(1, 0.5), (1, 0.7)], "k long, acc double")
    done = ck.complete_with_missing(res, ref, key=["k"], fill={"acc": 0.0})
    assert sorted((r.k, r.acc, r.is_filled) for r in done.rows.collect()) == [(1, 0.5, False), (1, 0.7, False), (2, 0.0, True), (3, 0.0, True)]
    assert done.verify() == {"n_reference": 3, "n_found": 1, "n_missing": 2, "n_unknown": 0}
    stray = res.unionByName(spark.createDataFrame([(9, 1.0)], "k long, acc double"))
    with pytest.raises(Exception, match="not in the reference: 9"):
        ck.complete_with_missing(stray, ref, key=["k"], fill={"acc": 0.0}).rows.collect()
    loose = ck.complete_with_missing(stray, ref, key=["k"], fill={"acc": 0.0}, strict=False)
    assert len(loose.rows.collect()) == 5 and loose.verify()["n_unknown"] == 1


def test_once_per_test(spark):
    ok = spark.createDataFrame([(1, 1, 7, "x"), (1, 2, 7, None)], "problem_id int, tc_no int, program_id int, output string")
    assert ck.once_per_test(ok).count() == 2
    with pytest.raises(Exception, match="several outputs of one test: 1, 1, 7"):
        ck.once_per_test(ok.unionByName(ok.limit(1))).collect()


def _brute_sets(rows):
    groups = collections.defaultdict(set)
    for p, t, prog, o in rows:
        groups[p, t, o].add(prog)
    own = {}
    for members in groups.values():
        for m in members:
            own[m] = own[m] & members if m in own else set(members)
    return {frozenset(s) for s in own.values() if len(s) > 1}, set(own)


@pytest.mark.parametrize("seed", range(3))
def test_co_location_equals_set_intersection(spark, seed):
    import random
    rng = random.Random(seed)
    rows = [(1, t, p, rng.choice(["x", None, "y"]) if p % 4 else "x") for p in range(40) for t in range(5) if rng.random() > 0.4 or p % 4 == 0]
    rows += [(1, 0, p, "second") for p in range(0, 40, 9)] + [(1, 0, 0, "x")]
    df = spark.createDataFrame(rows, "problem_id int, tc_no int, program_id int, output string")
    found = au.co_location(df)
    members = collections.defaultdict(set)
    for r in found["members"].collect():
        members[r.class_id].add(r.program_id)
        assert r.n_members and r.class_id <= r.program_id
    links = collections.defaultdict(set)
    for r in found["links"].collect():
        assert r.n_other == len(members[r.other_id])
        links[r.class_id].add(r.other_id)
    want, programs = _brute_sets(rows)
    got = {r.class_id: members[r.class_id].union(*(members[x] for x in links[r.class_id])) for r in found["sets"].collect()}
    assert {frozenset(s) for s in got.values()} == want and len(got) == len(want)
    assert all(r.n_programs == len(got[r.class_id]) for r in found["sets"].collect())
    c = au.unique_program_count_general(df).first()
    inside = set().union(*want) if want else set()
    assert (c.unique_programs, c.total_programs, c.n_sets) == (len(programs) - len(inside) + len(want), len(programs), len(want))


def test_co_location_of_regular_programs_needs_no_pairs(spark):
    rows = [(1, t, p, str(p % 3)) for p in range(30) for t in range(4)]
    df = spark.createDataFrame(rows, "problem_id int, tc_no int, program_id int, output string")
    found = au.co_location(df)
    assert found["links"].count() == 0 and sorted(r.n_programs for r in found["sets"].collect()) == [10, 10, 10]
    assert au.co_location(df.where("false"))["sets"].count() == 0


def test_infinite_speedup_before_a_gap(spark):
    df = spark.createDataFrame([(1, 10.0, 0, "c", 1.0, 0.0), (1, 10.0, 2, "c", 1.0, 5.0), (2, 10.0, 0, "c", 1.0, 5.0), (2, 10.0, 3, None, None, None)],
                               "src_id long, src_runtime double, gen_idx int, code string, accuracy double, agg_runtime double")
    got = {r.k: (r.n_inputs, r.mean_speedup, r.share_correct) for r in ev.best_at_k_summary(ev.best_at_k(df)).collect()}
    assert got == {1: (2, INF, 1.0), 3: (2, INF, 1.0), 4: (2, INF, 1.0)}


def test_compare_versions_rules(spark):
    runs = spark.createDataFrame([(1, "v0", 1, True, 2.0), (1, "v0", 2, True, 3.0), (1, "v1", 1, True, 1.0), (2, "v0", 1, False, 1.0), (2, "v1", 1, True, None), (3, "v1", 1, True, 4.0)],
                                 "submission_id long, version string, tc_no int, success boolean, t double")
    repeats = spark.createDataFrame([(1, "v0", 1, r, 1.0 + r) for r in range(3)] + [(1, "v1", 1, r, 2.0) for r in range(2)] + [(3, "v1", 1, 0, None)],
                                    "submission_id long, version string, tc_no int, rep int, t double")
    compiled = spark.createDataFrame([(1, "v0", True), (1, "v1", True), (2, "v0", True), (2, "v1", True), (3, "v1", False)], "submission_id long, version string, compiled boolean")
    got = {r.submission_id: r for r in rn.compare_versions(runs, repeats=repeats, compilation=compiled, map_limit=2).collect()}
    assert got[1].agg_runtime_v0 == 5.0 and got[1].speedup == 5.0 and got[1].agg_runtime_binary_v0 == 2.0 and got[1].agg_stdev_binary_v1 == 0.0
    assert got[1].tc2time_v0 == {1: 2.0, 2: 3.0} and got[2].tc2time_v0 == {1: INF} and got[2].tc2success_v1 == {1: True}
    assert got[2].agg_runtime_v1 == INF and got[2].agg_runtime_binary_v0 == INF
    assert got[3].compilation_v0 is False and got[3].agg_runtime_v0 == INF and got[3].n_tests_v0 == 0 and got[3].agg_runtime_v1 == INF
    both = {r.submission_id: r for r in rn.compare_versions(repeats=repeats, together=True).collect()}
    assert both[1].agg_runtime_binary_v0 == 1.5 and both[3].agg_runtime_binary_v1 == INF
    with pytest.raises(Exception, match="more than 1 tests"):
        rn.compare_versions(runs, map_limit=1).collect()


def test_second_prompts(spark):
    p = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3"), (4, None), (5, "p5")], "request_id int, prompt string")
    c = spark.createDataFrame([(1, "d1"), (2, au.FAILED_COMPLETION), (3, None), (4, "d4")], "request_id int, description string")
    got = {r.request_id: (r.failed, r.next_prompt) for r in au.continue_prompts(p, c).collect()}
    assert got[1] == (False, "p1d1\n\n" + au.CODE_DESCRIPTION_PAIR_END_TEMPLATE + "\n\n")
    assert got[2] == got[3] == got[5] == (True, None) and got[4] == (False, None)


def test_one_row_tables_side_by_side(spark):
    r = au.side_by_side(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "b string")).first()
    assert (r.a, r.b) == (1, "x")
