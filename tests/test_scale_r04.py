"""Shuffles and listings that must not come back."""

import re

import pytest
from pyspark.sql import functions as F

from pairlab.operators import reshape as rs
from pairlab.operators import scan
from pairlab.plans import jobs
from pairlab.sources import io

PAIRS = ("src_id long, problem_id long, src_code string, tgt_code string, src_agg_runtime double, tgt_agg_runtime double, "
         "generated_answers string")


def _plan(d):
    return d._jdf.queryExecution().toString()


LISTS = {0: "['a', 'b', 'c', 'd']", 1: "['a', None, 'c', '']", 2: None, 3: "[None]", 4: "plain"}
CODES = {0: [0, 1, 2, 3], 1: [0, 2], 2: [], 3: [], 4: [0]}


def _accuracy(i, g):
    return None if (i, g) == (5, 2) else 1.0 if (i + g) % 4 else 0.5


@pytest.mark.parametrize("rows", [1 << 19, 2])
def test_answers_lie_by_their_input(spark, monkeypatch, rows):
    """From parsing to the best of k nothing is shuffled by answers; few rows a partition: dealt out by their number."""
    monkeypatch.setattr(scan, "SPREAD_ROWS", rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # every eighth pair is identical, one comes twice
        pairs = [(i, i % 3, f"s{i}", f"s{i}" if i % 8 == 7 else f"t{i}", 100.0, 50.0, LISTS[i % 5]) for i in range(40)]
        measured = [(i, g, _accuracy(i, g), 10.0 * (g + 1)) for i in range(40) for g in range(4) if (i, g) != (5, 2)]
        d = spark.createDataFrame([*measured, measured[0]], "src_id long, gen_idx int, accuracy double, agg_runtime double")
        out = jobs.evaluate_answers(spark.createDataFrame([*pairs, pairs[0]], PAIRS), d if rows == 2 else d.repartition(8, "src_id"))
        plan = out["summary"]._jdf.queryExecution().executedPlan().toString()
        assert ("REPARTITION_BY_COL" in plan) == (rows > 2)
        assert not re.search(r"hashpartitioning\(src_id#\d+L?, (gen_idx|_blk)#", plan)
        got = {r["k"]: r for r in out["summary"].collect()}
        inputs = [i for i in range(40) if i % 8 != 7]
        assert sorted(got) == [1, 2, 3, 4]
        for k, r in got.items():
            right = {i: [10.0 * (g + 1) for g in CODES[i % 5] if g < k and _accuracy(i, g) == 1.0] for i in inputs}
            assert r["n_inputs"] == len(inputs)
            assert r["share_correct"] == pytest.approx(sum(map(bool, right.values())) / len(inputs))
            assert r["mean_speedup"] == pytest.approx(sum(100.0 / min(x) if x else 1.0 for x in right.values()) / len(inputs))
        # 2 x 2 rows of the first answer, 2 of each other one and of each program
        assert out["long"].filter("src_id = 0").count() == 4 + 3 * 2 + 2 * 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_attach_is_a_left_join(spark):
    left = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 0, "d"), (None, 0, "e"), (3, None, "f")], "k long, i int, x string")
    right = spark.createDataFrame([(1, 0, 1.0, None), (1, 0, None, None), (1, 5, 3.0, "z"), (None, 0, 9.0, "n"), (3, None, 9.0, "n"), (2, 0, 4.0, "y")], "k long, i int, v double, w string")
    rows = lambda d: sorted(map(str, d.select("k", "i", "x", "v", "w").collect()))
    assert rows(scan.attach(left, right, ["k", "i"])) == rows(left.join(right, ["k", "i"], "left"))
    near = scan.attach(left.repartition(8, "k"), right.repartition(8, "k"), ["k", "i"])
    assert near._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    assert rows(near) == rows(left.join(right, ["k", "i"], "left"))


def test_whole_keys_give_what_blocks_give(spark):
    d = spark.createDataFrame([(k, i, float((i * 7 + (k or 0)) % 5)) for k in (None, 1, 2, 3) for i in range(0, 12, 1 + (k or 0))], "k long, i long, v double")
    specs = [("lo", "min", "v", True), ("hi", "max", "v", False), ("s", "sum", "v", True)]
    rows = lambda b: sorted(map(str, scan.prefix_agg(d, ["k"], "i", specs, block_size=b, last_flag="last", next_order="next")
                                .select("k", "i", "lo", "hi", "s", "last", "next").collect()))
    assert rows(None) == rows(1 << 14)
    known = lambda b: [r for r in rows(b) if "k=None" not in r]
    assert known(None) == known(4)


def test_lists_are_parsed_where_they_are(spark):
    given = ["['a', 'b']", "['a', None]", "[None, 'x', 3]", "[1, 2]", "plain", "", None, "[broken", "[broken]", "['a', None]", "[]", "[{'a': 1}, None]"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "id long, a string")
    got = rs.parse_list_literal(d, ["a"])
    assert "Exchange" not in _plan(got) and "Join" not in _plan(got)
    want = {r["id"]: r["a"] for r in rs.parse_list_job(d, ["a"])[0].collect()}
    assert {r["id"]: r["a"] for r in got.collect()} == want
    assert want[1] == ["a", None] and want[2] == [None, "x", "3"] and want[8] is None and want[4] == ["plain"] and want[6] is None


def _write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text)


def test_testcases_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """No file is listed by the driver, which Spark's readers do; folders and files are dealt out by their number."""
    _write(tmp_path, {f"p{i}/{kind}.{t}.txt": f"{kind} {i} {t}".encode() for i in range(30) for t in range(4) for kind in ("input", "output")})
    _write(tmp_path, {"p3/input.big.txt": b"x", "p4/input.7.txt": b"alone"})
    monkeypatch.setattr(io, "FOLDERS_PER_TASK", 4)
    monkeypatch.setattr(io, "FILES_PER_TASK", 16)
    monkeypatch.setattr(type(spark.read), "text", lambda *a, **k: pytest.fail("listed by the driver"))
    allow = spark.createDataFrame([(f"p{i}", str(t)) for i in range(30) for t in (0, 2, 7)], "problem_id string, tc_no string")
    d = io.read_testcases(spark, str(tmp_path), allow)
    assert "16), REPARTITION_BY_NUM" in _plan(d)
    want = {(f"p{i}", t, f"input {i} {t}", f"output {i} {t}") for i in range(30) for t in (0, 2)} | {("p4", 7, "alone", None)}
    assert {tuple(r) for r in d.select("problem_id", "tc_no", "input", "expected").collect()} == want
    assert io.read_testcases(spark, str(tmp_path)).count() == 121


def test_testcases_of_odd_names(spark, tmp_path):
    """What Spark's readers give: names as in URIs, raw bytes, hidden folders, no empty files, tests that two files name."""
    _write(tmp_path, {"a b%/input.1.txt": b"x\xffy", "a b%/output.1.txt": b"", ".h/input.2.txt": b"\xef\xbb\xbfh\r\n", "q/input.3.txt": b"3", "q/input.03.txt": b"03",
                      "q/output.3.txt": b"o", "q/input.4.txt": b"", "q/deep/input.5.txt": b"d", "q/input.99999999999.txt": b"n", "\xe9#/input.6.txt": b"6"})
    rows = io.read_testcases(spark, str(tmp_path)).select("problem_id", "tc_no", F.hex(F.col("input").cast("binary")), "expected").collect()
    assert {tuple(r) for r in rows} == {("a%20b%25", 1, "78FF79", None), (".h", 2, "EFBBBF680D0A", None), ("q", 3, "33", "o"), ("q", 3, "3033", "o"), ("\xe9%23", 6, "36", None)}
    assert len(rows) == 5
    by_spark = io.read_testcases(spark, str(tmp_path)[:-1] + "*").select("problem_id", "tc_no", F.hex(F.col("input").cast("binary")), "expected").collect()
    assert {tuple(r) for r in rows} <= {tuple(r) for r in by_spark}
    for none in ("none", "q"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            io.read_testcases(spark, str(tmp_path / none))


def test_named_texts_of_one_split_are_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "FILES_PER_TASK", 10)
    d = spark.range(0, 95, 1, 1).select(F.format_string("f%02d/n%d.txt", F.floor(F.col("id") / 10), "id").alias("name"), F.when(F.col("id") != 5, F.col("id").cast("string")).alias("text"))
    made = []
    monkeypatch.setattr(type(d), "repartitionByRange", lambda self, n, *by, f=type(d).repartitionByRange: made.append((n, *by)) or f(self, n, *by))
    assert io.write_named_texts(d, str(tmp_path / "a"), n_rows=95) == 95
    assert io.write_named_texts(d, str(tmp_path / "b")) == 95 and made == [(10, "name")]
    for root in ("a", "b"):
        assert {p.relative_to(tmp_path / root).as_posix(): p.read_text() for p in (tmp_path / root).glob("*/*")} == {f"f{i // 10:02d}/n{i}.txt": "" if i == 5 else str(i) for i in range(95)}
