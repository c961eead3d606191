"""Long repeats of a corpus, found with run-compressed Burrows-Wheeler columns.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
anywhere else in the corpus.  Every window of that length has an anchor: its
smallest hash of ``ANCHOR`` bytes (the leftmost, on a tie).  Equal windows have equal
anchors at equal places, so consecutive windows with one anchor are kept together as
a context, and contexts are compared with those of equal anchors only.  An anchor
that occurs once clears its windows; a context that occurs twice marks them all;
both need no text.  The texts of what is left go to index shards by anchor.

A shard aligns its contexts at their anchors and sorts them by what follows.  Going
left, the text before the suffixes in their order is a column of the Burrows-Wheeler
transform, kept as runs; a stable sort by it (the LF step) gives the order one place
to the left.  Inside a run neighbours stay neighbours and their common prefix grows
by one byte; only at the head of a run a new neighbour appears, and its common prefix
is the least of the values sampled for the runs between.  So matching statistics (the
longest match of every suffix with any other context) stream from right to left, and
a window is marked where they reach ``LENGTH``.

Texts are written once, in blocks, to files in the shared folder.  Only names of
contexts, marks, and the contexts that have to be compared are shuffled.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import words as W
from pairlab.llm.base import shared_path, table, written
from pairlab.llm.files import new_file, open_in, open_out

LENGTH, ANCHOR = 400, 128
#: bytes of text in a block (a longer document is a block of its own)
BLOCK_BYTES = 2 << 20
#: contexts of a shard on average, and of one anchor; an anchor that has more is compared by hashes of windows
SHARD, CAP = 8_000, 8_000

_BITS = 20
_STEP = 1 << _BITS
_VALUES2 = W.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class _Hashes:
    """Hashes of any spans of a text, by sums of its bytes times powers."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        self.power, self.inverse = W._powers(len(data) + 1)
        self.total = np.empty(len(data) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(values[data] * self.power[:len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.inverse[start]


def window_anchors(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of texts: first window start, anchor, number of windows."""
    first_starts, anchors = [], []
    wide = length - anchor + 1
    docs = np.flatnonzero(np.diff(offsets) >= length)
    if not len(docs):
        return (np.zeros(0, np.int64),) * 3
    lo, hi = offsets[docs], offsets[docs + 1] - length + 1  # window starts of each text
    edge = np.zeros(len(data) + 1, np.int8)
    edge[lo] += 1
    edge[hi] -= 1
    valid = np.cumsum(edge)[:len(data)] > 0
    new_doc = np.zeros(len(data) + 1, dtype=bool)
    new_doc[lo] = True
    last = -1
    for s in range(0, len(data) - length + 1, _STEP - length + 1):
        d = data[s:s + _STEP]
        n = len(d) - anchor + 1
        m = len(d) - length + 1
        if not valid[s:s + m].any():
            continue
        h = W.mix64(_Hashes(d, W._VALUES).of(np.arange(n), np.arange(anchor, anchor + n)))
        key = (h & ~np.uint64(_STEP - 1)) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = key
        grid = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(behind[:m], ahead[wide - 1:wide - 1 + m])
        at = (least & np.uint64(_STEP - 1)).astype(np.int64) + s
        changed = np.empty(m, dtype=bool)
        changed[0] = s == 0 or at[0] != last
        changed[1:] = at[1:] != at[:-1]
        starts = np.flatnonzero((changed | new_doc[s:s + m]) & valid[s:s + m])
        first_starts.append(starts + s)
        anchors.append(at[starts])
        last = at[-1]
    a, p = np.concatenate(first_starts), np.concatenate(anchors)
    end = np.append(a[1:], len(data))
    text = np.searchsorted(lo, a, side="right") - 1
    return a, p, np.minimum(end, hi[text]) - a


class Block:
    """Texts and their contexts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, contexts: tuple[np.ndarray, np.ndarray, np.ndarray], length: int, anchor: int):
        self.data, self.offsets, self.length, self.anchor = data, offsets, length, anchor
        self.start, self.at, self.windows = contexts

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each context's anchor, and two hashes of the whole context and its place in it."""
        end = self.start + self.windows + self.length - 1
        hashes = _Hashes(self.data, W._VALUES)
        anchors, first = hashes.of(self.at, self.at + self.anchor), hashes.of(self.start, end)
        hashes = _Hashes(self.data, _VALUES2)  # one after the other: each holds 8 bytes a byte
        second = hashes.of(self.start, end)
        shape = W.mix64((self.at - self.start).astype(np.uint64) << np.uint64(32) | self.windows.astype(np.uint64))
        return W.mix64(anchors).view(np.int64), W.mix64(first ^ shape).view(np.int64), W.mix64(second + shape).view(np.int64)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQ", len(self.data), len(self.offsets), len(self.start))
        parts = [head, self.data.tobytes(), *(x.astype("<u8").tobytes() for x in (self.offsets, self.start, self.at - self.start, self.windows))]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def from_bytes(cls, raw: bytes, length: int, anchor: int) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        n, k, m = struct.unpack("<QQQ", raw[:24])
        data = np.frombuffer(raw, np.uint8, n, 24)
        flat = np.frombuffer(raw, "<u8", k + 3 * m, 24 + n).astype(np.int64)
        start, left, windows = flat[k:k + m], flat[k + m:k + 2 * m], flat[k + 2 * m:]
        return cls(data, flat[:k], (start, start + left, windows), length, anchor)


_FILES = "block long, file string, offset long, size long, doc_ids array<long>"


def _write_blocks(folder: str, length: int, anchor: int):
    schema = pa.schema([("block", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        path = new_file(folder, ".blocks")
        out, at, held, size = None, 0, [], 0

        def put() -> pa.RecordBatch:
            nonlocal out, at, held, size, block
            t = pa.Table.from_batches(held)
            data, offsets = W.utf8(t.column(1))
            raw = Block(data, offsets, window_anchors(data, offsets, length, anchor), length, anchor).to_bytes()
            out = out or open_out(path)
            out.write(raw)
            row = pa.RecordBatch.from_pydict({"block": [block], "file": [path], "offset": [at], "size": [len(raw)], "doc_ids": [t.column(0).to_pylist()]}, schema=schema)
            at, held, size, block = at + len(raw), [], 0, block + 1
            return row

        for b in batches:
            upto = np.concatenate([[0], np.cumsum(np.diff(W.utf8(b.column(1))[1]))])
            lo = 0
            while lo < b.num_rows:
                hi = int(np.searchsorted(upto, upto[lo] + BLOCK_BYTES - size, side="left"))
                hi = min(max(hi, lo + 1), b.num_rows)
                held.append(b.slice(lo, hi - lo))
                size += int(upto[hi] - upto[lo])
                lo = hi
                if size >= BLOCK_BYTES:
                    yield put()
        if held:
            yield put()
        if out:
            out.close()
    return write


def _read(path: str, offset: int, size: int, length: int, anchor: int) -> Block:
    with open_in(path) as f:
        f.seek(offset)
        return Block.from_bytes(f.read(size), length, anchor)


_NAMES = "block long, ah long, c1 long, c2 long, n long"


def _name_contexts(length: int, anchor: int):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, path, offset, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ah, c1, c2 = _read(path, offset, size, length, anchor).names()
                order = np.lexsort((c2, c1, ah))
                new = np.ones(len(order), dtype=bool)
                x, y, z = ah[order], c1[order], c2[order]
                new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.full(len(first), block, np.int64), x[first], y[first], z[first], n.astype(np.int64))],
                                                 names=["block", "ah", "c1", "c2", "n"])
    return name


def _find(c1: np.ndarray, c2: np.ndarray, want1: np.ndarray, want2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair (c1, c2): whether it is among the wanted ones, and which."""
    order = np.lexsort((want2, want1))
    names = np.zeros(len(c1) + len(want1), [("a", np.int64), ("b", np.int64)])
    names["a"], names["b"] = np.concatenate([want1, c1]), np.concatenate([want2, c2])
    ids = np.unique(names, return_inverse=True)[1].reshape(-1)
    slot = np.full(len(names), -1, np.int64)
    slot[ids[order]] = order
    found = slot[ids[len(want1):]]
    return found >= 0, found


_CONTEXT = "c1 long, c2 long, ah long, left int, windows int, n long, hot boolean, text binary"


def _ship_contexts(length: int, anchor: int):
    """The texts of the contexts that a block was asked for."""
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("ah", pa.int64()), ("left", pa.int32()), ("windows", pa.int32()), ("n", pa.int64()), ("hot", pa.bool_()), ("text", pa.binary())])

    def ship(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asked.num_rows:
            return schema.empty_table()
        r = blocks.to_pylist()[0]
        b = _read(r["file"], r["offset"], r["size"], length, anchor)
        ah, c1, c2 = b.names()
        found, which = _find(c1, c2, asked.column("c1").to_numpy(), asked.column("c2").to_numpy())
        hits = np.flatnonzero(found)
        hits = hits[np.unique(which[hits], return_index=True)[1]]  # one occurrence of each
        end = b.start[hits] + b.windows[hits] + length - 1
        text = pa.array([b.data[i:j].tobytes() for i, j in zip(b.start[hits].tolist(), end.tolist(), strict=True)], pa.binary())
        asked_at = pa.array(which[hits])
        return pa.table([pa.array(c1[hits]), pa.array(c2[hits]), pa.array(ah[hits]), pa.array((b.at - b.start)[hits].astype(np.int32)), pa.array(b.windows[hits].astype(np.int32)),
                         asked.column("n").take(asked_at), asked.column("hot").take(asked_at), text], schema=schema)
    return ship


class RunIndex:
    """Run-compressed Burrows-Wheeler columns of texts aligned at one place.

    ``texts[i]`` has its aligned byte at ``left[i]``.  ``matches`` streams, from the
    aligned place to the left, the longest match of every suffix with another text.
    """

    def __init__(self, texts: list[bytes], left: np.ndarray):
        self.left = left
        size = np.array([len(t) for t in texts], np.int64)
        self.wide = int(left.max(initial=0))
        self.right = size - left
        width = self.wide + int(self.right.max(initial=0))
        # a column per place; 0 is no byte
        self.columns = np.zeros((width, len(texts)), np.uint16)
        for lo in range(0, len(texts), 512):  # a few rows at a time, then turned
            part = np.zeros((min(512, len(texts) - lo), width), np.uint16)
            for i, t in enumerate(texts[lo:lo + 512]):
                at = self.wide - int(left[lo + i])
                part[i, at:at + len(t)] = np.frombuffer(t, np.uint8)
                part[i, at:at + len(t)] += np.uint16(1)
            self.columns[:, lo:lo + len(part)] = part.T

    def _aligned(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of the texts from the aligned place on, and the common prefixes of neighbours."""
        tail = np.ascontiguousarray(self.columns[self.wide:].T.astype(">u2"))
        order = np.argsort(tail.view(f"S{2 * tail.shape[1]}").reshape(-1), kind="stable")
        common = np.zeros(len(order), np.int64)
        for lo in range(0, len(order) - 1, 4096):
            x, y = tail[order[lo:lo + 4096]], tail[order[lo + 1:lo + 4097]]
            x = x[:len(y)]
            same = (x == y) & (x > 0)
            common[lo + 1:lo + 1 + len(y)] = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
        return order, common

    def matches(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bytes left of the aligned place, texts, longest match of each from there on)."""
        order, common = self._aligned()
        yield 0, order, self._longest(common)
        for step in range(1, self.wide + 1):
            column = self.columns[self.wide - step][order]
            # runs of the column: heads, bytes, and the least common prefix sampled for each
            heads = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            byte = column[heads]
            least = np.minimum.reduceat(common, heads)
            grown = common + 1
            # a head's new neighbour is the end of the run before with its byte
            by_byte = np.argsort(byte, kind="stable")
            again = np.flatnonzero(byte[by_byte][1:] == byte[by_byte][:-1])
            earlier, now = by_byte[again], by_byte[again + 1]
            new = np.zeros(len(heads), np.int64)
            if len(now):
                between = np.minimum.reduceat(np.append(least, np.iinfo(np.int64).max), np.stack([earlier + 1, now], axis=1).reshape(-1))[::2]
                inside = np.where(earlier + 1 < now, between, np.iinfo(np.int64).max)
                new[now] = np.minimum(inside, common[heads[now]]) + 1
            grown[heads] = new
            grown[column == 0] = 0
            place = np.argsort(column, kind="stable")  # LF
            order, common = order[place], grown[place]
            yield step, order, self._longest(common)

    @staticmethod
    def _longest(common: np.ndarray) -> np.ndarray:
        return np.maximum(common, np.append(common[1:], 0))


_MARKS = "c1 long, c2 long, bits binary"


def _shard_marks(length: int):
    """A shard's contexts to those with marked windows: a bit per window."""
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("bits", pa.binary())])

    def marks(t: pa.Table) -> pa.Table:
        left = t.column("left").to_numpy().astype(np.int64)
        windows = t.column("windows").to_numpy().astype(np.int64)
        index = RunIndex(t.column("text").to_pylist(), left)
        marked = np.zeros((len(left), int(windows.max()) if len(windows) else 0), dtype=bool)
        for step, order, longest in index.matches():
            hit = order[longest >= length]
            window = left[hit] - step
            ok = (window >= 0) & (window < windows[hit])
            marked[hit[ok], window[ok]] = True
        rows = np.flatnonzero(marked.any(axis=1))
        return pa.table([t.column("c1").take(pa.array(rows)), t.column("c2").take(pa.array(rows)), pa.array([np.packbits(marked[i]).tobytes() for i in rows], pa.binary())], schema=schema)
    return marks


def _window_rows(length: int):
    """Contexts to a row per window: c1, c2, window, two hashes of its text."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c1, c2, text in zip(*(b.column(k).to_pylist() for k in ("c1", "c2", "text")), strict=True):
                d = np.frombuffer(text, np.uint8)
                at = np.arange(len(d) - length + 1)
                w = [W.mix64(_Hashes(d, v).of(at, at + length)).view(np.int64) for v in (W._VALUES, _VALUES2)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c1)), pa.array(np.full(len(at), c2)), pa.array(at), *map(pa.array, w)], names=["c1", "c2", "window", "w1", "w2"])
    return windows


def _window_bits(t: pa.Table) -> pa.Table:
    marked = np.zeros(int(max(t.column("window").to_numpy())) + 1, dtype=bool)
    marked[t.column("window").to_numpy()] = True
    return pa.table([t.column("c1").slice(0, 1), t.column("c2").slice(0, 1), pa.array([np.packbits(marked).tobytes()], pa.binary())], names=["c1", "c2", "bits"])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(length: int, anchor: int):
    """A block and its marked contexts to what is left of its texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(blocks: pa.Table, marks: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return schema.empty_table()
        r = blocks.to_pylist()[0]
        b = _read(r["file"], r["offset"], r["size"], length, anchor)
        n = len(b.data)
        edge = np.zeros(n + 1, np.int64)
        if marks.num_rows:
            _, c1, c2 = b.names()
            found, which = _find(c1, c2, marks.column("c1").to_numpy(), marks.column("c2").to_numpy())
            hits = np.flatnonzero(found)
            bits = marks.column("bits").to_pylist()
            whole = np.array([not x for x in bits], dtype=bool)  # no bits: every window
            all_of = hits[whole[which[hits]]]
            np.add.at(edge, b.start[all_of], 1)
            np.add.at(edge, b.start[all_of] + b.windows[all_of] + length - 1, -1)
            for i in hits[~whole[which[hits]]]:
                on = np.flatnonzero(np.unpackbits(np.frombuffer(bits[which[i]], np.uint8))) + b.start[i]
                np.add.at(edge, on, 1)
                np.add.at(edge, on + length, -1)
        gone = np.cumsum(edge[:n]) > 0
        out = []
        for doc_id, lo, hi in zip(r["doc_ids"], b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
            g = gone[lo:hi]
            spans = int((g[1:] & ~g[:-1]).sum() + (hi > lo and g[0]))
            kept = b.data[lo:hi] if not spans else b.data[lo:hi][~g]
            out.append((doc_id, hi - lo, int(g.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        return pa.table([pa.array([x[i] for x in out], schema.field(i).type) for i in range(5)], schema=schema)
    return cut


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard: int = SHARD, cap: int = CAP) -> DataFrame:
    """What is left of the texts of ``docs`` (doc_id, text) without the bytes of repeated strings of ``length`` bytes.

    Returns per row doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256, all of the text's UTF-8 bytes.  A null text is empty; equal rows and
    equal or null ids are texts of their own, so both lose what they share; other
    columns are not read.  An anchor with more than ``cap`` different contexts is
    compared window by window through hashes, with the same result.  Two numbers
    reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = written(rows.mapInArrow(_write_blocks(shared_path(spark, "texts"), length, anchor), _FILES), "blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = written(blocks.select("block", "file", "offset", "size").repartition(parts, "block").mapInArrow(_name_contexts(length, anchor), _NAMES), "contexts")

    contexts = names.groupBy("ah", "c1", "c2").agg(F.sum("n").alias("n"), F.min("block").alias("block"))
    anchors = names.groupBy("ah").agg(F.sum("n").alias("times"), F.approx_count_distinct("c1").alias("kinds"), F.min("c1").alias("low"), F.max("c1").alias("high"),
                                      F.min("c2").alias("low2"), F.max("c2").alias("high2"))
    anchors = anchors.where("times > 1").withColumn("single", F.expr("low = high AND low2 = high2"))
    known = written(contexts.join(anchors.select("ah", "single", (F.col("kinds") > cap).alias("hot")), "ah"), "repeated-anchors")
    asked = written(known.where("NOT single").select("block", "c1", "c2", "n", "hot"), "asked")
    places = blocks.select("block", "file", "offset", "size").repartition(parts, "block")
    sent = places.groupBy("block").cogroup(asked.repartition(parts, "block").groupBy("block")).applyInArrow(_ship_contexts(length, anchor), _CONTEXT)
    sizes = asked.agg(F.count_if(~F.col("hot")).alias("shared"), F.count_if("hot").alias("hot")).first()
    by_shard = F.pmod("ah", F.lit(max(1, -(-sizes.shared // shard)))).alias("shard")
    if sizes.hot:  # both kinds read what was sent
        sent = written(sent, "sent")
    partly = sent.where("NOT hot").withColumn("shard", by_shard).repartition(parts, "shard").groupBy("shard").applyInArrow(_shard_marks(length), _MARKS)
    if sizes.hot:
        found = sent.where("hot").mapInArrow(_window_rows(length), "c1 long, c2 long, window long, w1 long, w2 long")
        pairs = found.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
        partly = partly.unionByName(found.join(pairs, ["w1", "w2"]).groupBy("c1", "c2").applyInArrow(_window_bits, _MARKS))
    every = known.where("n > 1").select("c1", "c2", F.lit(b"").alias("bits"))
    once = known.where("n = 1").select("c1", "c2")
    marks = written(every.unionByName(partly.join(once, ["c1", "c2"])), "marks")

    told = names.select("block", "c1", "c2").join(marks, ["c1", "c2"])
    places = blocks.select("block", "file", "offset", "size", "doc_ids").repartition(parts, "block")
    return places.groupBy("block").cogroup(told.repartition(parts, "block").groupBy("block")).applyInArrow(_cut(length, anchor), _RESULT)


def op13_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole ``documents`` without the bytes of repeated strings of 400 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS x FROM documents)
, part AS (SELECT row, 500 * j AS lo, substr(x, 1000 * j + 1, {2 * LENGTH + 998}) AS x FROM t, unnest(range((length(x) // 2 - {LENGTH}) // 500 + 1)) AS u(j) WHERE length(x) >= {2 * LENGTH})
, w AS (SELECT row, lo + i AS i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS h FROM part, unnest(range(least(length(x) // 2 - {LENGTH - 1}, 500))) AS u(i))
, twice AS (SELECT row, i FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1)
, new AS (SELECT row, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM twice)
, runs AS (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS run FROM new)
, gone AS (SELECT row, min(i) AS a, max(i) + {LENGTH} AS b FROM runs GROUP BY row, run)
, gaps AS (SELECT row, a, b, lag(b, 1, 0) OVER (PARTITION BY row ORDER BY a) AS before FROM gone)
, cut AS (SELECT row, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
          FROM gaps JOIN t USING (row) GROUP BY row)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM t LEFT JOIN cut USING (row)"""
