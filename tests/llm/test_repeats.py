"""Removal of repeated strings against a brute-force version."""

import collections
import hashlib
import random

import numpy as np
import pytest
from conftest import SF_SMALL

from pairlab.llm import repeats


def brute(docs, length):
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        seen.update(b[k:k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _odd_docs(length):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    passage, other = word(3 * length), word(2 * length)
    docs = [(0, None), (1, ""), (2, "x"), (3, "a" * 5 * length), (4, "ab" * 4 * length), (5, passage), (5, passage), (None, passage + "q"), (7, "\0" * 2 * length)]
    docs += [(i, word(rng.randint(0, 20)) + passage[rng.randint(0, length):] + word(rng.randint(0, 20))) for i in range(10, 60)]
    docs += [(i, word(rng.randint(0, length)) + other[:length + rng.randint(-3, 3)] + word(length)) for i in range(60, 90)]
    docs += [(i, word(rng.randint(0, 6 * length))) for i in range(90, 120)]
    long = word(4000)
    return docs + [(200, long + "z" + long[:-1]), (201, word(500) + long[300:300 + length - 1] + "#" + long[300:300 + length])]


@pytest.mark.parametrize("length,anchor,shard,cap", [(24, 8, 20_000, 20_000), (24, 8, 15, 20_000), (30, 5, 40, 3), (16, 16, 10, 20_000)])
def test_equals_brute_force(spark, length, anchor, shard, cap):
    docs = _odd_docs(length)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, block int, file string").repartition(3)
    assert rows_of(repeats.remove_repeats(df, length, anchor, shard, cap)) == brute(docs, length)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    out = repeats.op13_run_length_index(spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = brute(docs, 400)
    assert rows_of(out) == want and any(r[2] for r in want)


def test_empty_and_short(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(none).count() == 0
    short = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None)], "doc_id long, text string")
    assert rows_of(repeats.remove_repeats(short)) == brute([(1, "ab"), (2, "ab"), (3, None)], 400)


def test_anchors_cover_windows_across_slices(monkeypatch):
    monkeypatch.setattr(repeats, "_BITS", 8)
    monkeypatch.setattr(repeats, "_STEP", 256)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 700, 710, 710, 3000])
    a, p, n = repeats.window_anchors(data, offsets, 40, 10)
    starts = np.concatenate([np.arange(x, x + k) for x, k in zip(a, n)])
    assert starts.tolist() == [*range(0, 661), *range(710, 2961)]
    assert ((p >= a + n - 1) & (p <= a + 30)).all()


def test_matching_statistics():
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))).encode() for _ in range(60)})
    left = np.array([rng.randint(0, len(t) - 1) for t in texts])
    wide = int(left.max())
    for step, order, longest in repeats.RunIndex(texts, left).matches():
        for i, got in zip(order.tolist(), longest.tolist()):
            if left[i] < step:
                continue
            mine = texts[i][left[i] - step:]
            others = [t[left[j] - step:] for j, t in enumerate(texts) if j != i and left[j] >= step]
            assert got == max((next((k for k in range(min(len(mine), len(o))) if mine[k] != o[k]), min(len(mine), len(o))) for o in others), default=0)
    assert step == wide
