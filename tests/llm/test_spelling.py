"""Spelling variants against a brute-force version."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

from pairlab.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(docs, min_length=7, min_count=2):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(words, ratio=10):
    by_size = collections.defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def rows_of(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    out = spelling.op12_reduced_alphabet(spark, SF_SMALL)
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert rows_of(out) == brute_groups(brute_words(docs))


def test_vocabulary_of_odd_texts(spark):
    long = "straße " * 3 + "Aé" * 5000 + " " + "überall" * 20000
    docs = [(0, None), (1, ""), (2, "ÀÉÎÕÜßÿ×÷ ÀÉÎÕÜßÿ×÷ œuvre-maximum œuvre-maximum"), (None, "Maximum maximum"), (3, long), (3, long), (4, "x1maximums2maximums日本maximums")]
    df = spark.createDataFrame([(*d, "word", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in spelling.vocabulary(df).collect()}
    assert got == brute_words(docs)
    assert spelling.vocabulary(df.where("false")).count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_near_words_equal_all_pairs(spark, symbols):
    rng = random.Random(symbols)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(300)} | {"z" * 3000, "z" * 2999, "q" + "z" * 2999}
    df = spark.createDataFrame([(w, 1) for w in words] + [(None, 5)], "word string, n int")
    got = {(r.word, r.near) for r in spelling.near_words(df, symbols, bits=12).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b)}


def test_chains_ties_and_ratio(spark):
    words = {"aaaaaaaa": 100_000, "aaaaaaab": 10_000, "aaaaaabb": 1_000, "aaaaabbb": 100, "aaaabbbb": 10, "aaabbbbb": 1,
             "ccccccc": 50, "ccccccd": 500, "cccccce": 500, "fffffff": 50, "ffffffg": 499, "hhhhhhh": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumnRenamed("n", "n")
    got = rows_of(spelling.spelling_groups(df))
    assert got == brute_groups(words)
    assert got["aaabbbbb"][1] == "aaaaaaaa" and got["ccccccc"][0] == "ccccccd" and got["fffffff"][0] is None
    assert spelling.spelling_groups(df.where("false")).count() == 0


def test_crc_and_runs():
    data = np.frombuffer("Größe, x Ünïcode日本 abc".encode(), np.uint8)
    start, end, length, first = spelling.letter_runs(data, np.array([0, 8, len(data)]))
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["Größe", "x", "Ünïcode", "abc"]
    assert length.tolist() == [5, 1, 7, 3] and first.tolist() == [0, 1, 4]
    before = np.array([zlib.crc32(b"17:")] * 4, np.uint32)
    assert spelling.crc32_spans(data, start, end, before).tolist() == [zlib.crc32(b"17:" + bytes(data[a:b])) for a, b in zip(start, end)]
    long = np.frombuffer(b"ab" * 500 + b"xyz", np.uint8)
    assert spelling.crc32_spans(long, np.array([1000, 0]), np.array([1003, 1000]), np.zeros(2, np.uint32)).tolist() == [zlib.crc32(b"xyz"), zlib.crc32(b"ab" * 500)]
