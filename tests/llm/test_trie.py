"""The conversation trie against a brute-force version."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

from pairlab.llm import trie


def brute(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: y[:3])] for c, v in by.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - int(np.fmod(c, 5))
        paths[c] = own.get(source, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(paths[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def key(r):
    return r[0], r[1]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_query_equals_brute_force(spark):
    raw = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = trie.op11_double_array_trie(spark, SF_SMALL)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(out) == brute(raw)


def _odd_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(-7, 40), 10**12]:
        for t in range(rng.choice([0, 1, 2, 5, 9, 14])):
            rows.append((c, t if t else None, rng.choice(["user", None]) if t % 2 else "a", rng.choice(["x", "é", "", None])))
    rows += [(2, t, "u", "same") for t in range(60)] + [(c, t, "u", "same") for c in range(50, 90) for t in range(12)]
    rows += [(100, 0, "u", "long " * 50_000), (101, 0, "u", "long " * 50_000), (None, 0, "u", "x"), (None, 1, None, None)]
    rows += [(7, 3, "z", "twice"), (7, 3, "z", "twice")]
    return rows


@pytest.mark.parametrize("segment,shard", [(64, 20_000), (3, 5), (1, 4)])
def test_odd_conversations(spark, segment, shard):
    rows = _odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, pos int, n string")
    got = rows_of(trie.conversation_trie(*trie.rebuild(df), segment=segment, shard=shard))
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(*trie.rebuild(df)).count() == 0


def test_hot_list_of_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 100)
    ids = spark.range(0, 5000).selectExpr("1L a", "2L b", "id * 3 AS conv_id").unionByName(spark.range(5).selectExpr("id a", "0L b", "-id AS conv_id"))
    got = {(r.a, r.b): r.ends_sha256 for r in trie.ends_digests(ids).collect()}
    assert got[1, 2] == hashlib.sha256(",".join(str(3 * i) for i in range(5000)).encode()).hexdigest()
    assert got[4, 0] == hashlib.sha256(b"-4").hexdigest() and len(got) == 6


def test_double_array_walks_every_path():
    rng = np.random.default_rng(5)
    paths = [rng.integers(0, 30, rng.integers(1, 9)) for _ in range(500)]
    size = np.array([len(p) for p in paths])
    t = trie.pack(np.concatenate(paths), size)
    known = {tuple(p[:d]) for p in map(tuple, paths) for d in range(len(p) + 1)}
    assert (t.check >= 0).sum() == len(known)
    seen = {}
    for p in paths:
        s = np.zeros(1, np.int64)
        for d in range(len(p)):
            s = t.step(s, p[d:d + 1])
            assert seen.setdefault(int(s[0]), tuple(p[:d + 1])) == tuple(p[:d + 1])
        for x in range(30):
            assert (t.step(s, np.array([x]))[0] >= 0) == ((*p, x) in known)
