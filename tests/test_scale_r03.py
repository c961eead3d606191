"""Figures that must not grow with the input: partitions, windows of long texts, blocks of searches."""

import re
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.tokenizers import SubwordTokenizer
from pairlab.operators import augment as au
from pairlab.operators import checks as ck
from pairlab.operators import evaluate as ev
from pairlab.operators import retrieve as rt
from pairlab.operators import runs as rn
from pairlab.operators import scan, texts
from pairlab.plans import fixtures


def _plan(d):
    return d._jdf.queryExecution().toString()


def _grams(text, n=3, dims=64):
    out = [0.0] * dims
    for i in range(len(text) - n + 1):
        h = int(md5(text[i:i + n].encode()).hexdigest()[:8], 16)
        out[h % dims] += 1.0 if h // dims % 2 == 0 else -1.0
    return out


def test_grams_of_long_texts_are_not_rows(spark):
    given = ["long é\U0001f600 text " * 4000, "Ab", "", "abc", "abc", None, "x" * 50_000]
    df = spark.createDataFrame(list(enumerate(given)), "id long, t string")
    d = rt.hashed_ngrams(df, "t")
    assert "Generate" not in d._jdf.queryExecution().toString()
    got = {r["id"]: r["embedding"] and list(r["embedding"]) for r in d.collect()}
    assert got == {i: None if t is None else _grams(t.lower()) for i, t in enumerate(given)}


def test_grams_of_any_length_and_windows(monkeypatch):
    given = ["abcabd" * 7, "ß\U0001f600z" * 20, "a"]
    want = {n: [_grams(t, n, 8) for t in given] for n in (1, 2, 3, 4, 6)}
    for chars in (1, 5, 1 << 19):
        monkeypatch.setattr(rt, "GRAM_CHARS", chars)
        assert {n: rt.gram_sums(given, n, 8).tolist() for n in want} == want


def test_small_files_of_many_rows_are_many_tasks(spark, tmpdir_fresh):
    n = 3 * (1 << 13)
    spark.range(n).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).coalesce(1).write.parquet(f"{tmpdir_fresh}/customer.parquet")
    for t in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmpdir_fresh}/{t}.parquet")
    v = fixtures.view(spark, tmpdir_fresh, "v_outputs")
    assert v.rdd.getNumPartitions() == 3
    assert v.count() == n * 125


def test_lines_of_expected_numbers(spark):
    rows = [("1\n2.0004\nend", "1\n2.0\nend"), ("1\nx\nend", "1\n2\nend"), ("nan\n1", "nan\n1"), ("inf\n1", "inf\n2"), ("1", "1.0001\n2"), ("", "1\n2"),
            ("a\nb\nc", "a\nb"), (None, "a\nb"), ("a\nb", None), ("a\nb", " "), ("2\n\n3", "2.0\n\n3.1")]
    d = spark.createDataFrame(rows, "o string, e string")
    got = [r[0] for r in d.select(rn.output_accuracy("o", "e")).collect()]
    assert got == [1.0, 2 / 3, 1.0, 0.5, 0.5, 0.0, 1.0, None, None, None, 2 / 3]


def test_partitions_of_a_check_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(scan, "SPREAD_ROWS", 100)
    o = spark.range(3000).select((F.col("id") % 3).alias("problem_id"), (F.col("id") % 10).alias("tc_no"), F.col("id").alias("program_id"), F.lit("x").alias("output"))
    d = ck.once_per_test(o)
    assert "30), REPARTITION_BY_NUM" in _plan(d)
    assert d.count() == 3000 and sorted(d.columns) == ["output", "problem_id", "program_id", "tc_no"]
    with pytest.raises(Exception, match="several outputs of one test"):
        ck.once_per_test(o.unionByName(o.limit(1))).collect()


def test_outputs_are_not_shuffled_by_test(spark, monkeypatch):
    monkeypatch.setattr(scan, "SMALL_ROWS", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o = spark.range(20_000).select((F.col("id") % 2).alias("problem_id"), F.floor(F.col("id") / 2 % 25).alias("tc_no"), F.floor(F.col("id") / 50).alias("program_id"),
                                       F.when(F.col("id") / 50 < 200, "a").otherwise(F.col("id").cast("string")).alias("output"))
        cands, refs = o.filter("program_id % 2 = 0"), o.filter("program_id % 2 = 1")
        d = au.novelty_filter(cands, refs, o)
        assert not re.search(r"hashpartitioning\(problem_id#\d+L?, tc_no#\d+L?, \d+\)", _plan(d))
        got = {tuple(r) for r in d.collect()}
        assert len(got) == 400 and got == {(p, c, True, 100 if c < 200 else 0, c >= 200) for p in (0, 1) for c in range(0, 400, 2)}
        monkeypatch.setattr(scan, "SMALL_ROWS", 0)
        assert {tuple(r) for r in au.novelty_filter(cands, refs, o).collect()} == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_verdicts_do_not_meet_by_problem(spark):
    """Problems are few and have any number of programs: what is known of a problem goes to its programs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o = spark.range(600).select((F.col("id") % 2).alias("problem_id"), (F.col("id") % 6).alias("tc_no"), F.floor(F.col("id") / 6).alias("program_id"),
                                    F.when(F.col("id") < 300, "a").otherwise(F.col("id").cast("string")).alias("output"))
        d = au.novelty_filter(o.filter("program_id % 2 = 0"), o.filter("program_id % 2 = 1"), o)
        assert not re.search(r"hashpartitioning\(problem_id#\d+L?, \d+\)", _plan(d))
        assert {tuple(r) for r in d.collect()} == {(p, c, True, 25 if c < 50 else 0, c >= 50) for p in (0, 1) for c in range(0, 100, 2)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_search_of_few_parts_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(rt, "KNN_FILE_ROWS", 40)
    monkeypatch.setattr(rt, "KNN_ROWS", 16)
    monkeypatch.setattr(rt, "KNN_CELLS", 64)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(150, 4)), np.repeat(rng.normal(size=(3, 4)), 10, axis=0)])
    e = spark.createDataFrame([(f"v{i}", x.tolist()) for i, x in enumerate(v)], "id string, embedding array<double>")
    d = rt.knn_join(e.withColumnRenamed("id", "query_id"), e.withColumnRenamed("id", "neighbor_id"), k=5, qkey="query_id", ckey="neighbor_id", corpus_partitions=1)
    assert max(int(n) for n in re.findall(r"rangepartitioning\(at#\d+L? ASC NULLS FIRST, (\d+)\)", _plan(d))) >= 8
    want = set()
    for i, x in enumerate(v):
        near = sorted((float(((x - y) ** 2).sum()), f"v{j}") for j, y in enumerate(v) if j != i)[:5]
        want |= {(f"v{i}", r, n) for r, (_, n) in enumerate(near, 1)}
    assert {(r["query_id"], r["rank"], r["neighbor_id"]) for r in d.collect()} == want


def test_transformations_get_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(texts, "BATCH_CHARS", 1000)
    pieces = list(texts._pieces(pa.RecordBatch.from_arrays([pa.array(["h"] * 7), pa.array(["x" * 400, None, "é" * 400, "y", "z" * 5000, "", "w"])], names=["h", "t"]), 1))
    assert [p.num_rows for p in pieces] == [3, 2, 2]
    assert pa.Table.from_batches(pieces).num_rows == 7
    df = spark.createDataFrame([(i, None if i % 50 == 3 else f"{i % 70} " * i) for i in range(200)], "id long, t string")
    got = texts.transform_texts(df, "t", lambda ts: [len(t) for t in ts], out="n", to=T.LongType())
    assert all(r["n"] == (None if r["t"] is None else len(r["t"])) for r in got.rows.collect())


def test_counts_of_tokens_are_lengths_of_ids():
    import public_tokenizers
    t = ["Some text\n\n  of words", "", "naïve \U0001f600 <|endoftext|>", "x" * 5000]
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        tok = SubwordTokenizer(public_tokenizers.path(name))
        assert tok.count(t) == [len(i) for i in tok.encode(t)] and tok.decode(tok.encode(t)) == t


def test_answers_are_spread_by_their_number(spark, monkeypatch):
    rows = [(i, i % 7, 100.0, 50.0, g, None if (i + g) % 5 == 0 else "c", 1.0, float(10 + (i * g) % 40)) for i in range(300) for g in range(i % 4)]
    g = spark.createDataFrame(rows + rows[:50], "src_id long, problem_id long, src_runtime double, tgt_runtime double, gen_idx int, code string, accuracy double, agg_runtime double")
    inputs = spark.range(300).select(F.col("id").alias("src_id"), (F.col("id") % 7).alias("problem_id"), F.lit(100.0).alias("src_runtime"), F.lit(50.0).alias("tgt_runtime"))
    rounded = lambda d: sorted(tuple(round(x, 9) for x in r) for r in d.collect())
    plain = rounded(ev.evaluate(g, inputs)["summary"])
    monkeypatch.setattr(scan, "SPREAD_ROWS", 40)
    d = ev.evaluate(g, inputs)["summary"]
    assert "REPARTITION_BY_NUM" in _plan(d)
    assert rounded(d) == plain
