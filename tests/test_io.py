import json
import os

import pytest
from pyspark.sql import types as T

from pairlab.sources import io

SCHEMA = T.StructType([T.StructField("src_id", T.LongType()), T.StructField("speedup", T.DoubleType())])


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_records_roundtrip_and_inf_rule(spark, tmpdir_fresh):
    df = spark.createDataFrame([(1, float("inf")), (2, 1.5)], SCHEMA)
    io.write_records(df, f"{tmpdir_fresh}/a", inf_as_null=True)
    back = {r["src_id"]: r["speedup"] for r in io.read_records(spark, f"{tmpdir_fresh}/a", SCHEMA).collect()}
    assert back == {1: None, 2: 1.5}
    with pytest.raises(ValueError):
        io.read_records(spark, f"{tmpdir_fresh}/a", SCHEMA, required=["missing"])


def test_failfast_on_bad_line(spark, tmpdir_fresh):
    write(f"{tmpdir_fresh}/bad/x.jsonl", '{"src_id": 1}\n{not json\n')
    with pytest.raises(Exception):
        io.read_records(spark, f"{tmpdir_fresh}/bad", SCHEMA).collect()


def test_splits(spark, tmpdir_fresh):
    for s in ("train", "test"):
        write(f"{tmpdir_fresh}/{s}/p.jsonl", '{"src_id": 1, "speedup": 2.0}\n')
    d = io.read_splits(spark, {s: f"{tmpdir_fresh}/{s}" for s in ("train", "test")}, SCHEMA)
    assert sorted(r["split"] for r in d.collect()) == ["test", "train"]


def test_csv_bad_rows_are_routed(spark, tmpdir_fresh):
    write(f"{tmpdir_fresh}/m/a.csv", "step,loss\n1,0.5\n2,0.25\n")
    write(f"{tmpdir_fresh}/m/b.csv", "step,loss\nx,y,z\n3,0.1\n")
    schema = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("loss", T.DoubleType())])
    good, bad = io.read_csv_metrics(spark, f"{tmpdir_fresh}/m", schema)
    good = good.cache()
    assert sorted(r["step"] for r in good.collect()) == [1, 2, 3]
    assert bad.count() == 1


def test_keyed_documents_and_testcases(spark, tmpdir_fresh):
    write(f"{tmpdir_fresh}/desc/p001.html", "  <p>Hello</p>\n")
    write(f"{tmpdir_fresh}/desc/p002.v2.html", "<p>Other</p>")
    docs = {r["key"]: r["text"] for r in io.read_keyed_documents(spark, f"{tmpdir_fresh}/desc/*.html").collect()}
    assert docs == {"p001": "<p>Hello</p>", "p002": "<p>Other</p>"}
    for tc in (0, 1, 10):
        write(f"{tmpdir_fresh}/tc/p001/input.{tc}.txt", f"in{tc}")
        write(f"{tmpdir_fresh}/tc/p001/output.{tc}.txt", f"out{tc}")
    tcs = io.read_testcases(spark, f"{tmpdir_fresh}/tc")
    assert sorted(r["tc_no"] for r in tcs.collect()) == [0, 1, 10]
    allow = spark.createDataFrame([("p001", "10")], "problem_id string, tc_no string")
    assert [r["expected"] for r in io.read_testcases(spark, f"{tmpdir_fresh}/tc", allow).collect()] == ["out10"]


def test_timing_json(spark, tmpdir_fresh):
    doc = {"results": [{"command": "./a.out < input_3.txt", "mean": 1.5, "times": [1.0, 2.0]}]}
    write(f"{tmpdir_fresh}/t/a.json", json.dumps(doc))
    write(f"{tmpdir_fresh}/t/b.json", "{broken")
    rows = io.read_timing_json(spark, f"{tmpdir_fresh}/t").collect()
    assert [(r["tc_no"], r["mean"], r["times"]) for r in rows] == [(3, 1.5, [1.0, 2.0])]


def test_summary_append_stage_and_versions(spark, tmpdir_fresh):
    df = spark.createDataFrame([(1, 2.0)], SCHEMA)
    io.write_summary(df, f"{tmpdir_fresh}/s", experiment="e1")
    io.write_summary(df, f"{tmpdir_fresh}/s", experiment="e2")
    assert spark.read.option("header", "true").csv(f"{tmpdir_fresh}/s").count() == 2
    calls = []

    def build():
        calls.append(1)
        return df

    a = io.stage(spark, f"{tmpdir_fresh}/st", build)
    b = io.stage(spark, f"{tmpdir_fresh}/st", build)
    assert calls == [1] and a.collect() == b.collect()
    p1 = io.versioned_write(df, f"{tmpdir_fresh}/v", "r1")
    io.versioned_write(df, f"{tmpdir_fresh}/v", "r2")
    with pytest.raises(Exception):
        io.versioned_write(df, f"{tmpdir_fresh}/v", "r1")
    assert spark.read.parquet(p1).count() == 1


def test_normalise_keyed_json(spark):
    df = spark.createDataFrame([("p1", json.dumps({"3": {"out a": ["g1", "g2"]}, "10": {"b": ["g3"]}}))],
                               "problem_id string, j string")
    rows = sorted((r["tc_no"], r["output"], r["program_id"]) for r in io.normalise_keyed_json(df, "j").collect())
    assert rows == [(3, "out a", "g1"), (3, "out a", "g2"), (10, "b", "g3")]


def test_csv_values_with_line_breaks(spark, tmp_path):
    from pyspark.sql import types as T
    from pairlab.sources import io
    schema = T.StructType([T.StructField("step", T.LongType()), T.StructField("note", T.StringType())])
    (tmp_path / "a.csv").write_text('note,step\n"one\ntwo, ""three""\n",1\n\nplain,2\nodd,x\n"last",3')
    (tmp_path / "b.csv").write_text('4,"\r\n"\n5,')
    good, bad = io.read_csv_metrics(spark, str(tmp_path / "*.csv"), schema, multiline=True)
    assert {r.step: r.note for r in good.collect()} == {1: 'one\ntwo, "three"\n', 2: "plain", 3: "last", 4: "\n", 5: None}
    assert [r.raw for r in bad.collect()] == ["odd,x"]
