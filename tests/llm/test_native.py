"""Host reputation, sharding and mixing: oracles, brute force and edge cases."""

import re
import zlib

import pytest

from conftest import SF_SMALL
from pairlab.llm import hosts, mix, shard
from pairlab.llm.base import word_count
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string"
ROWS = [(1, "a b c", "s1"), (1, "a b c", "s1"), (2, None, "s1"), (3, "", "s2"), (None, "x", None), (4, "w " * 5000, "s2"), (5, "é\u00a0b c", "s2"), (-7, "neg", "s1")]


def oracle_rows(sql):
    from pairlab.plans.check import duck
    con = duck(SF_SMALL)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    return {tuple(sorted(zip(names, r, strict=True))) for r in res.fetchall()}


@pytest.mark.parametrize("name", ["op6_weighted_mix", "op9_host_reputation"])
def test_oracle(spark, name):
    from pairlab.llm.queries import ORACLES, QUERIES
    got = {tuple(sorted(r.asDict().items())) for r in QUERIES[name](spark, SF_SMALL).collect()}
    assert got == oracle_rows(ORACLES[name])


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 40, 300])
def test_jump_hash(spark, shards):
    keys = [0, 1, -1, 2**62, -2**63, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for r in shard.assign_shards(df, shards=shards).collect():
        assert (r.shard, r.grown_shard) == (jump(r.doc_id & (2**64 - 1), shards), jump(r.doc_id & (2**64 - 1), shards + 1))
        assert r.grown_shard in (r.shard, shards)


def test_slots_are_gapless_for_hot_and_null_keys(spark):
    rows = [(7, str(i % 50)) for i in range(600)] + [(None, "n")] * 20 + [(i, "t") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("old")).withColumn("shard", F.lit(-1))
    out = shard.number_slots(shard.assign_shards(df, shards=5), shard.text_crc32(F.col("text")), blocks=8).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == len(rows) and set(by) <= set(range(5))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in out if r.doc_id == 7}) == 1


def test_shard_query(spark):
    from pairlab.llm.queries import QUERIES
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op7_jump_hash_shards"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard) == (len(raw) + 16, zlib.crc32(raw), "key", jump(r.doc_id, 40))


def test_shard_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert shard.number_slots(shard.assign_shards(df), shard.text_crc32(F.col("text"))).collect() == []


def fill(sizes, weights, total):
    left = dict(sizes)
    target = {}
    while left:
        w = sum(weights[s] for s in left)
        over = [s for s in left if total * weights[s] / w > 2 * left[s] + 1e-9]
        if not over:
            return target | {s: total * weights[s] / w for s in left}
        for s in over:
            target[s] = 2.0 * left.pop(s)
        total = 1.5 * sum(sizes.values()) - sum(target.values())
    return target


def mixed(spark, rows, **kw):
    df = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash")).withColumn("copies", F.lit(9))
    return mix.mix_sources(df, word_count(F.col("text")), F.lit(1.0), **kw).collect()


def test_mix_edge_cases(spark):
    out = mixed(spark, ROWS)
    assert len(out) == len(ROWS)
    sizes, weights = {"s1": 7, "s2": 5002, None: 1}, {"s1": 5, "s2": 2, None: 1}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()))
    for r in out:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.copies <= 2
    assert mixed(spark, []) == []


def test_mix_fills_targets_and_splits_a_hot_source(spark):
    rows = [(i, "w " * (1 + i % 37), "hot" if i % 3 else f"s{i % 9}") for i in range(1500)]
    out = mixed(spark, rows, blocks=16)
    sizes = {s: sum(r.size for r in out if r.source == s) for s in {r.source for r in out}}
    want = fill(sizes, dict(zip(sorted(sizes), [5, 2, 1] * 9, strict=False)), 1.5 * sum(sizes.values()))
    for s in sizes:
        taken = sum(r.size * r.copies for r in out if r.source == s)
        assert abs(taken - want[s]) <= 37
    assert {(r.doc_id, r.copies) for r in out} == {(r.doc_id, r.copies) for r in mixed(spark, rows[::-1], blocks=3)}


def test_mix_prefers_quality(spark):
    rows = [(i, "w " * 10, "a") for i in range(2000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("q", F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(0.5))
    out = mix.mix_sources(df, word_count(F.col("text")), F.col("q"), share=0.5).collect()
    good = sum(r.copies for r in out if r.doc_id % 2 == 0)
    assert good > 2 * (sum(r.copies for r in out) - good)


def test_quality_weights_with_repeated_and_null_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = {(r.doc_id, r["__quality"]) for r in mix.quality_weight(docs, labels).collect()}
    assert got == {(1, 2.0), (2, 0.5), (3, 1.0), (None, 1.0)}


URLS = [("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://b.net", "b.net", "", None, None),
        ("https://b.net/", "b.net", "/", "net/", "block"), ("ftp://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("x://y.org/fr/a", "y.org", "/fr/a", "org/fr/", "allow"), ("http://notnet/", "notnet", "/", None, None), (None, "", "", None, None),
        ("no scheme/net/", "", "", None, None), ("http://h?a=b://c/d", "h", "", None, None), ("//://É.net/en", "É.net", "/en", "net/", "block")]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)] + [(0, URLS[0][0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    out = hosts.judge_urls(pages, labels).collect()
    assert len(out) == len(URLS) + 1
    for r in out:
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow")
    assert hosts.judge_urls(spark.createDataFrame([], "page_id long, url string"), labels).collect() == []


def test_reputation_shrinks_to_the_domain(spark):
    rows = [(f"h{i}.bad.com", True) for i in range(5) for _ in range(30)] + [(f"h{i}.good.com", False) for i in range(5) for _ in range(30)]
    rows += [("new.bad.com", None), ("new.good.com", None), ("one.good.com", True)]
    out = {r.host: r for r in hosts.host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert out["h0.bad.com"].lower > 0.5 and out["h0.good.com"].mean < 0.1
    assert out["new.bad.com"].mean > 0.6 > 0.4 > out["new.good.com"].mean
    assert out["one.good.com"].lower < 0.5  # one label does not condemn a host of a good domain
    assert out["new.bad.com"].n == 0 and out["one.good.com"].n_bad == 1
