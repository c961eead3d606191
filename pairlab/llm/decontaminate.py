"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are sequences of words (A-Z lower-cased runs of letters and
digits; ASCII punctuation splits).  An item leaks into a text when some stretch
of the text is within ``EDITS`` of the item's length in word edits.

* Windows of an item's size class start at every word of every text.  A window
  that holds a leak keeps at least ``size - 1 - 2 * edits`` of the item's word
  pairs.  A pair counts at most as often as an item has it, so repeated words do
  not add up.  Windows with fewer are passed over: an exact bound, which loses
  none.  The same bound for the one item comes before its verification.
* A CGK walk copies the current word and moves on or stays by a random bit of
  the step and the word; a few edits then cost few differing steps.  Each of
  ``WALKS`` walks samples ``SAMPLES`` steps into a key; a window and an item
  with a common key are a candidate.  With steps agreeing at ``AGREE`` one
  window meets its item with the chance ``RECALL``; a leak has many (its
  neighbours and the nearby sizes), tests measure what that comes to.
* Candidates are verified by the exact edit distance of the whole item against
  the stretch around the window.

Texts are never shuffled, and scanned once.  The benchmark is a stated query set: a
Spark job compiles it in blocks of about ``BLOCK_BYTES`` of text to files in the
shared folder; a task holds its texts, batch by batch, against one block after
another.  The driver sees the names of the files only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import words as W
from pairlab.llm.base import shared_path, table, written
from pairlab.llm.files import new_file, open_in, open_out

#: word edits allowed, as a share of the item's words
EDITS = 0.2
#: sampled steps of a walk; share of steps that agree for a leak; recall to reach by one window
SAMPLES, AGREE, RECALL = 2, 0.5, 0.96
WALKS = ceil(log(1 - RECALL) / log(1 - AGREE ** SAMPLES))
#: steps of a walk per word of the window
STRETCH = 3
#: ratio between the window sizes of neighbouring classes
GROWTH = 1.15
#: items of fewer words must occur as they are
SHORT = 5
BLOCK_BYTES = 8 << 20

_SPLIT = np.ones(256, dtype=bool)
_SPLIT[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _SPLIT[_a:_b] = False
_PAD = np.uint64(0)


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, first word of each text) for chunks of a string array."""
    data, offsets = W.utf8(texts)
    for lo, d, o in W.chunks(data, offsets):
        start, end, first = W.spans(d, o, _SPLIT)
        yield lo, W.hash_spans(d, start, end, lower=True), first


def edits(n: int) -> int:
    return int(EDITS * n + 1e-9)


def size_classes(longest: int) -> list[int]:
    out = [SHORT]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return [c for c in out if c <= longest]


def _sampled(size: int) -> np.ndarray:
    """The steps that each walk samples, for windows of ``size`` words; walks that go farther come first."""
    r = W.mix64(np.arange(1, WALKS * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size))
    steps = (r % np.uint64(STRETCH * size)).astype(np.int64).reshape(WALKS, SAMPLES)
    return steps[np.argsort(-steps.max(axis=1), kind="stable")]


def cgk_keys(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Keys (walk, window) of windows ``start`` of at most ``size`` words that stop at ``end``."""
    steps = _sampled(size)
    s = np.concatenate([symbols, [_PAD]])
    n = len(s)
    row = (np.arange(WALKS) * n)[:, None]
    at = row + start[None, :]
    limit = row + np.minimum(start + size, end)[None, :]
    pad = row + n - 1
    keys = np.full(at.shape, size, dtype=np.uint64)
    seeds = W.mix64(np.arange(1, WALKS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    farthest = steps.max(axis=1)
    for j in range(int(farthest[0]) + 1):
        if j % 64 == 0:
            coins = W.mix64(s[None, :] ^ W.mix64(seeds + np.uint64(j // 64 + 1))[:, None])
        k = int((farthest >= j).sum())  # walks still going
        here = np.where(at[:k] < limit[:k], at[:k], pad[:k])
        for w, t in np.argwhere(steps[:k] == j):
            keys[w] = W.mix64(keys[w] * np.uint64(0x100000001B3) + s[here[w] - w * n] + np.uint64(t))
        at[:k] += ((coins[:k] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64).reshape(-1).take(here)
    return W.mix64(keys + np.arange(WALKS, dtype=np.uint64)[:, None])


@dataclass
class Benchmark:
    """What a block of items looks like to a task."""
    ids: np.ndarray
    items: list[np.ndarray]
    pairs: np.ndarray
    most: np.ndarray  # how often one item has a pair at most
    item_pairs: np.ndarray  # sorted item * len(pairs) + pair
    classes: dict[int, tuple[np.ndarray, np.ndarray, int, int]]  # size: keys, their items, span, least pairs
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def compile_benchmark(ids: list[int], texts: list[str | None]) -> Benchmark:
    items: list[np.ndarray] = []
    for _, h, first in _words(pa.array(texts, pa.string())):
        items += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    sizes = np.array([len(i) for i in items])
    counted = [np.unique(W.window_hash(i, 2), return_counts=True) if len(i) >= SHORT else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for i in items]
    pairs, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *[p for p, _ in counted]]), return_inverse=True)
    most = np.zeros(len(pairs), np.int64)
    np.maximum.at(most, at, np.concatenate([np.zeros(0, np.int64), *[n for _, n in counted]]))
    item_pairs = np.sort(np.repeat(np.arange(len(items)), [len(p) for p, _ in counted]) * len(pairs) + at)
    classes, short = {}, {}
    grid = np.array(size_classes(int(sizes.max(initial=0))))
    of = np.searchsorted(grid, sizes, side="right") - 1
    for c, size in enumerate(grid):
        mine = np.flatnonzero((of == c) & (sizes >= SHORT))
        if len(mine):
            keys = np.concatenate([cgk_keys(items[i], np.array([0]), np.array([sizes[i]]), int(size)).reshape(-1) for i in mine])
            order = np.argsort(keys, kind="stable")
            k = edits(int(sizes[mine].max()))
            classes[int(size)] = keys[order], np.repeat(mine, WALKS)[order], int(size) + k, int(size) - 1 - 2 * k
    for n in range(1, SHORT):
        mine = np.flatnonzero(sizes == n)
        if len(mine):
            keys = np.array([W.window_hash(items[i], n)[0] for i in mine], dtype=np.uint64)
            order = np.argsort(keys, kind="stable")
            short[n] = keys[order], mine[order]
    return Benchmark(np.array(ids, dtype=np.int64), items, pairs, most, item_pairs, classes, short)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``text`` nearest to ``item`` in word edits (the first such end)."""
    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        index = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else index.copy()
        for i, x in enumerate(a, 1):
            best = np.empty_like(row)
            best[0] = i
            best[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
            row = np.minimum.accumulate(best - index) + index
        return row
    row = last_row(item, text, True)
    end = int(row.argmin())
    back = last_row(item[::-1], text[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (wanted, sorted keys) of equal values."""
    lo, hi = np.searchsorted(keys, wanted, side="left"), np.searchsorted(keys, wanted, side="right")
    n = hi - lo
    which = np.repeat(np.arange(len(wanted)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _earlier(code: np.ndarray, at: np.ndarray, most: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """For each occurrence the first start of a window that holds at most ``most`` of its code up to it."""
    order = np.argsort(code, kind="stable")
    rank = np.arange(len(order))
    begins = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]])) if len(order) else rank
    begin = np.repeat(begins, np.diff(np.concatenate([begins, [len(order)]])))
    back = rank - most[order]
    out = np.zeros(len(order), np.int64)
    out[order] = np.where(back >= begin, at[order[np.maximum(back, 0)]] + 1, 0)
    return np.maximum(out, text_start)


def candidates(bench: Benchmark, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, item) pairs, windows of the texts that share a key with an item; then the places and codes of benchmark pairs."""
    if not len(h) or not bench.classes:
        return (np.zeros(0, np.int64),) * 4
    pair = W.window_hash(h, 2)
    at = np.searchsorted(bench.pairs, pair)
    at[at == len(bench.pairs)] = 0
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hit = np.flatnonzero((bench.pairs[at] == pair) & (owner[:len(pair)] == owner[1:])) if len(pair) else np.zeros(0, np.int64)
    before = _earlier(at[hit], hit, bench.most[at[hit]], first[owner[hit]])
    starts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, (keys, item, span, least) in bench.classes.items():
        # a pair at p counts for the windows that start after its earlier occurrences and reach it
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, np.maximum(before, hit - span + 2), 1)
        np.add.at(edge, hit + 1, -1)
        window = np.flatnonzero(np.cumsum(edge[:-1]) >= max(least, 1))
        stop = first[1:][owner[window]]
        for i in range(0, len(window), 4096):
            part, limit = window[i:i + 4096], stop[i:i + 4096]
            if len(part):
                # walk over the words near these windows only
                near = np.unique((part[:, None] + np.arange(0, size + 64, 64)[None, :]).reshape(-1) // 64)
                words = (near[:, None] * 64 + np.arange(64)[None, :]).reshape(-1)
                words = words[words < len(h)]
                move = np.searchsorted(words, part)
                got = cgk_keys(h[words], move, move + (np.minimum(limit, part + size) - part), size)
                which, found = _lookup(keys, got.reshape(-1))
                starts.append(part[which % len(part)])
                items.append(item[found])
    code = np.unique(np.concatenate(starts) * len(bench.items) + np.concatenate(items))
    return code // len(bench.items), code % len(bench.items), hit, at[hit]


def _shared_pairs(bench: Benchmark, item: np.ndarray, a: np.ndarray, b: np.ndarray, hit: np.ndarray, code: np.ndarray) -> np.ndarray:
    """How many of its item's distinct pairs each stretch ``a:b`` has."""
    out = np.zeros(len(a), np.int64)
    lo, hi = np.searchsorted(hit, a), np.searchsorted(hit, b - 1)
    for i in range(0, len(a), 4096):
        n = np.maximum(hi[i:i + 4096] - lo[i:i + 4096], 0)
        which = np.repeat(np.arange(i, i + len(n)), n)
        there = code[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[i:i + 4096], n)]
        wanted = item[which] * len(bench.pairs) + there
        k = np.minimum(np.searchsorted(bench.item_pairs, wanted), len(bench.item_pairs) - 1)
        own = bench.item_pairs[k] == wanted
        out += np.bincount(np.unique(which[own] * len(bench.pairs) + there[own]) // len(bench.pairs), minlength=len(a))
    return out


def _distinct(bench: Benchmark) -> np.ndarray:
    """How many distinct pairs each item has; each edit takes away at most two."""
    return np.bincount(bench.item_pairs // max(1, len(bench.pairs)), minlength=len(bench.items))


def leaks_of(bench: Benchmark, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, distance, start, end): the nearest stretch of each leaked item, in words."""
    for lo, h, first in _words(texts):
        start, item, hit, code = candidates(bench, h, first)
        text = np.searchsorted(first, start, side="right") - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        order = np.lexsort((start, item, text))
        start, item, text = start[order], item[order], text[order]
        size = np.array([len(i) for i in bench.items], np.int64)[item]
        # runs of near windows are one stretch
        new = np.ones(len(start), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[1:])
        begins = np.flatnonzero(new)
        ends = np.concatenate([begins[1:], [len(start)]])[:len(begins)] - 1
        n, t, which = size[begins], text[begins], item[begins]
        k = (EDITS * n + 1e-9).astype(np.int64)
        a = np.maximum(first[t], start[begins] - 2 * k - 1)
        b = np.minimum(first[t + 1], start[ends] + n + 2 * k + 1)
        likely = np.flatnonzero(_shared_pairs(bench, which, a, b, hit, code) >= _distinct(bench)[which] - 2 * k)
        for n, t, which, a, b in zip(*(x[likely].tolist() for x in (n, t, which, a, b)), strict=True):
            d, s, e = edit_distance(bench.items[which], h[a:b])
            if d <= edits(n):
                found = (d, a + s - int(first[t]), a + e - int(first[t]))
                best[t, which] = min(best.get((t, which), found), found)
        for n, (keys, ids) in bench.short.items():
            windows = W.window_hash(h, n) if n > 1 else W.mix64(h)
            which, found = _lookup(keys, windows)
            for s, f in zip(which, found, strict=True):
                t = int(np.searchsorted(first, s, side="right") - 1)
                if s + n <= first[t + 1]:
                    hit = (0, int(s - first[t]), int(s - first[t]) + n)
                    best[t, int(ids[f])] = min(best.get((t, int(ids[f])), hit), hit)
        for (t, i), (d, s, e) in sorted(best.items()):
            yield lo + t, i, d, s, e


_LEAKS = "doc_id long, text_hash long, item_id long, item_words long, distance long, start long, end long"


_COMPILED = "file string, n_items int"


def _compile(folder: str):
    """Items to compiled blocks of bounded size, each a file of its own."""
    def compile_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str | None] = []
        size = 0

        def put() -> pa.RecordBatch:
            path = new_file(folder, ".items")
            with open_out(path) as f:
                f.write(pickle.dumps(compile_benchmark(ids, texts)))
            return pa.RecordBatch.from_pydict({"file": [path], "n_items": pa.array([len(ids)], pa.int32())})

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(-1 if i is None else i)
                texts.append(t)
                size += len(t or "") + 64
                if size >= BLOCK_BYTES:
                    yield put()
                    ids, texts, size = [], [], 0
        if ids:
            yield put()
    return compile_items


#: the block that a worker read last
_HELD: dict[str, Benchmark] = {}


def _block(path: str) -> Benchmark:
    if path not in _HELD:
        _HELD.clear()
        with open_in(path) as f:
            _HELD[path] = pickle.loads(f.read())
    return _HELD[path]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Items of ``benchmark`` (item_id, text) that leak into ``docs`` (doc_id, text).

    Per document and leaked item: text_hash (xxhash64 of the text), item_words, the edit distance of the nearest
    stretch, its start and end (words, end exclusive).  Null and empty texts
    leak nothing, items without words are never found; a null item_id is -1.
    Repeated documents have rows each; an item that occurs several times in a
    document has one.  Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    blocks = written(items.mapInArrow(_compile(shared_path(spark, "benchmark")), _COMPILED), "benchmark-blocks")
    paths = sorted(r.file for r in blocks.collect())  # names, one per block

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in paths:
                bench = _block(path)
                rows = list(leaks_of(bench, b.column(1)))
                if rows:
                    t, i, d, s, e = map(np.array, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), b.column(2).take(pa.array(t)), *[pa.array(x) for x in (
                        bench.ids[i], np.array([len(bench.items[k]) for k in i]), d, s, e)]], names=["doc_id", "text_hash", "item_id", "item_words", "distance", "start", "end"])

    return texts.mapInArrow(search, _LEAKS)


def op4_cgk_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of ``benchmark`` in the whole texts of ``documents``."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
