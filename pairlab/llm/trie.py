"""Prefix tries of conversations as double arrays.

Conversations are paths of turns; a node is a distinct sequence of first turns.
Paths are cut into segments of ``SEGMENT`` turns, so a row is bounded however long
a conversation is.  Equal segments below the same prefix become one row with a
count.  Segments, sorted in trie order, are dealt in prefix shards of ``SHARD``
segments; a hot prefix therefore spreads over as many shards as it needs.

A shard numbers its turns densely, packs its trie into a double array (the child
of state ``s`` by turn ``t`` is ``BASE[s] + t``, if ``CHECK`` there says ``s``) and
traverses it for its nodes.  Neighbouring shards share nodes on the paths between
them only: a shard sees the last segment before it and the first after it, so every
node is owned by one shard, and all that shards say of a node adds up globally.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import words as W
from pairlab.llm.base import table, written
from pairlab.llm.sql import crc32_sql
from pairlab.operators.scan import dense_index, prefix_agg

#: turns of a segment, and segments of a shard
SEGMENT, SHARD = 64, 20_000
#: conversations by groups of so many share a start of at most ``SHARED - 1`` turns
GROUP, SHARED = 5, 9
#: ids in a piece of a node's list of ids
IDS = 1 << 16

_PRIME = (1 << 31) - 1
_LANES = (1_103_515_245, 1_664_525, 69_069_069, 22_695_477)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class DoubleArray:
    """A trie over dense labels, packed into BASE and CHECK.

    ``parent`` and ``label`` give the nodes (parents first, node 0 the root);
    ``state[i]`` is the state of node ``i``.  Nodes of several children take the
    first place where all their labels are free (after ``TRIES`` failures the end);
    those of one child fill the gaps.
    """

    TRIES = 64

    def __init__(self, parent: np.ndarray, label: np.ndarray):
        n = len(parent)
        order = np.lexsort((label[1:], parent[1:])) + 1
        who, first, size = np.unique(parent[order], return_index=True, return_counts=True)
        check = np.full(2 * n + int(label.max(initial=0)) + 2, -1, np.int64)
        check[0] = 0  # the root's own place
        base = np.zeros(n, np.int64)
        free, end = 1, 1  # all places before `free` are taken, all from `end` on are not
        for k in np.argsort(-size, kind="stable")[:int((size > 1).sum())]:
            labels = label[order[first[k]:first[k] + size[k]]]
            offsets = labels - labels[0]
            while check[free] >= 0:
                free += 1
            at = free
            for _ in range(self.TRIES):
                if at >= end or at + offsets[-1] < len(check) and (check[at + offsets] < 0).all():
                    break
                at += 1
            else:
                at = end
            if at + offsets[-1] + 1 >= len(check):
                check = np.concatenate([check, np.full(int(offsets[-1]) + len(check), -1, np.int64)])
            base[who[k]] = at - labels[0]
            check[at + offsets] = who[k]
            end = max(end, at + int(offsets[-1]) + 1)
        single = np.flatnonzero(size == 1)
        gaps = np.flatnonzero(check < 0)
        if len(gaps) < len(single):
            gaps = np.concatenate([gaps, len(check) + np.arange(len(single) - len(gaps))])
            check = np.concatenate([check, np.full(len(single), -1, np.int64)])
        place = gaps[:len(single)]
        base[who[single]] = place - label[order[first[single]]]
        check[place] = who[single]
        self.state = np.zeros(n, np.int64)
        self.state[1:] = base[parent[1:]] + label[1:]
        # from nodes to states
        used = check >= 0
        self.check = np.full(len(check), -1, np.int64)
        self.check[used] = self.state[check[used]]
        self.base = np.zeros(len(check), np.int64)
        self.base[self.state] = base

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The child of each state by a label, -1 where there is none."""
        at = self.base[states] + labels
        inside = (at > 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == states), at, -1)


def pack(flat: np.ndarray, size: np.ndarray) -> DoubleArray:
    """A double array of all prefixes of paths (``size[i]`` labels of ``flat`` each)."""
    first = np.cumsum(size) - size
    node = np.zeros(len(size), np.int64)
    parent, label, n = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
    many = int(flat.max(initial=0)) + 1
    for d in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > d)
        pairs, index = np.unique(node[live] * many + flat[first[live] + d], return_inverse=True)
        parent.append(pairs // many)
        label.append(pairs % many)
        node[live] = n + index
        n += len(pairs)
    return DoubleArray(np.concatenate(parent), np.concatenate(label))


class _Paths:
    """Turn arrays of an Arrow column, flattened."""

    def __init__(self, turns: pa.Array | pa.ChunkedArray):
        t = turns.combine_chunks() if isinstance(turns, pa.ChunkedArray) else turns
        t = pa.concat_arrays([t.cast(t.type)]) if t.offset else t
        self.offsets = t.offsets.to_numpy().astype(np.int64)
        flat = t.values
        self.h1, self.h2 = (flat.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in ("h1", "h2"))
        self.bytes = flat.field("bytes").to_numpy(zero_copy_only=False)
        self.size = np.diff(self.offsets)
        self.first = self.offsets[:-1]

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(paths, turns) by depth: the paths that long, and their turns there."""
        for d in range(int(self.size.max(initial=0))):
            live = np.flatnonzero(self.size > d)
            yield live, self.first[live] + d

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of every prefix of every path, by its last turn."""
        a, b = np.zeros(len(self.h1), np.uint64), np.zeros(len(self.h1), np.uint64)
        va, vb = np.zeros(len(self.size), np.uint64), np.zeros(len(self.size), np.uint64)
        for live, at in self.steps():
            va[live] = a[at] = W.mix64(va[live] * _A + self.h1[at])
            vb[live] = b[at] = W.mix64(vb[live] * _B + self.h2[at])
        return a, b


def _key(start: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Name of a prefix: of its segment's start, and the chain from there."""
    return W.mix64(W.mix64(start + _A) ^ chain).view(np.int64)


_TURNS = "array<struct<pos:long,h1:long,h2:long,bytes:long>>"
_KEYED = f"conv_id long, seg long, turns {_TURNS}, total long, g1 long, g2 long, g3 long, g4 long"


def _with_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what each segment adds to the polynomials that name the prefixes at ends of segments."""
    for b in batches:
        paths = _Paths(b.column(2))
        ca, cb = paths.chains()
        last = paths.offsets[1:] - 1
        whole = W.mix64(ca[last]) ^ cb[last]
        columns = []
        for k, x in enumerate(_LANES):
            g = (W.mix64(whole + np.uint64(k)) % np.uint64(_PRIME)).tolist()
            columns.append(pa.array([v * pow(x, s, _PRIME) % _PRIME for v, s in zip(g, b.column(1).to_pylist(), strict=True)], pa.int64()))
        yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "g1", "g2", "g3", "g4"])


def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """Turns (conv_id, pos, total, h1, h2, bytes) to segments with names of the prefixes that they start (sa, sb) and, if whole, end at (ea, eb)."""
    cut = turns.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "bytes"))).alias("turns"), F.max("total").alias("total"))
    summed = written(cut.mapInArrow(_with_sums, _KEYED), "segments")
    zero = [F.lit(0).cast("bigint").alias(f"q{i}") for i in range(1, 5)]
    one = summed.where(F.col("total") <= segment).select("*", *zero)
    many = prefix_agg(summed.where(F.col("total") > segment), ["conv_id"], "seg", [(f"q{i}", "sum", f"g{i}", False) for i in range(1, 5)])

    def key(after: bool) -> list[Column]:
        q = [(F.coalesce(F.col(f"q{i}"), F.lit(0)) + (F.col(f"g{i}") if after else F.lit(0))) % _PRIME for i in range(1, 5)]
        return [F.shiftleft(q[0], 31).bitwiseOR(q[1]), F.shiftleft(q[2], 31).bitwiseOR(q[3])]

    s, e = key(False), key(True)
    return one.unionByName(many).select("conv_id", "seg", "turns", "total", s[0].alias("sa"), s[1].alias("sb"), e[0].alias("ea"), e[1].alias("eb"))


def _views(t: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy().view(np.uint64) for n in names]


def _ends(segment: int):
    """Last segments to (a, b, conv_id): the node at which a conversation ends."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            t = pa.Table.from_batches([t])
            paths = _Paths(t.column("turns"))
            last = paths.offsets[1:] - 1
            full = paths.size == segment
            sa, sb, ea, eb = _views(t, "sa", "sb", "ea", "eb")
            ca, cb = paths.chains()
            a, b = np.where(full, ea.view(np.int64), _key(sa, ca[last])), np.where(full, eb.view(np.int64), _key(sb, cb[last]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), t.column("conv_id").combine_chunks()], names=["a", "b", "conv_id"])
    return ends


_NODE_NAMES = ("a", "b", "pa", "pb", "start", "depth", "n", "conv_id", "kids", "leaves", "weight", "once")
_NODE = ", ".join(f"{k} {'boolean' if k == 'start' else 'long'}" for k in _NODE_NAMES)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def _shard_nodes(segment: int):
    """A shard's segments, with the one before and the one after, to its nodes and what they add to the global ones.

    ``n``: conversations; ``weight``: n times bytes, ``once``: bytes, ``leaves``:
    childless nodes, all three summed over the part of the subtree in this shard
    (the last two only over nodes that this shard owns); ``kids``: owned children.
    """
    def nodes(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        role = t.column("role").to_numpy()
        paths = _Paths(t.column("turns"))
        sa, sb, ea, eb = _views(t, "sa", "sb", "ea", "eb")
        seg = t.column("seg").to_numpy()
        # dense labels: starts, then turns; a path is its start and its turns
        starts = np.unique(np.stack([seg.view(np.uint64), sa, sb], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        turn = np.unique(np.stack([paths.h1, paths.h2], axis=1), axis=0, return_inverse=True)[1].reshape(-1) + len(seg)
        size = paths.size + 1
        first = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int64)
        flat[first] = starts
        inner = np.ones(len(flat), dtype=bool)
        inner[first] = False
        flat[inner] = turn
        path = lambda i: flat[first[i]:first[i] + size[i]]
        own = np.flatnonzero(role == 0)
        lo, hi = own[0], own[-1]
        shared = _common(path(lo - 1), path(lo)) if lo > 0 else 0  # nodes of the first path that an earlier shard owns
        goes_on = hi + 1 < len(role) and _common(path(hi), path(hi + 1)) == size[hi]
        cut = slice(int(first[lo]), int(first[hi] + size[hi]))
        trie = pack(flat[cut], size[own])
        # traverse: all paths at once, a turn a step
        m = len(trie.check)
        local, count, byte = np.full(m, -1, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        low = np.full(m, np.iinfo(np.int64).max)
        level, key_a, key_b = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        ca, cb = paths.chains()
        times, convs = t.column("n").to_numpy(), t.column("conv_id").to_numpy()
        state = np.zeros(len(role), np.int64)
        on_first = []
        for d in range(int(size[own].max())):
            live = own[size[own] > d]
            state[live] = now = trie.step(state[live], flat[first[live] + d])
            local[now], level[now] = d, seg[live]
            if live[0] == lo:
                on_first.append(int(now[0]))
            if d == 0:
                key_a[now], key_b[now] = sa[live].view(np.int64), sb[live].view(np.int64)
                continue
            at = paths.first[live] + d - 1
            full = d == segment
            key_a[now] = ea[live].view(np.int64) if full else _key(sa[live], ca[at])
            key_b[now] = eb[live].view(np.int64) if full else _key(sb[live], cb[at])
            byte[now] = paths.bytes[at]
            np.add.at(count, now, times[live])
            np.minimum.at(low, now, convs[live])
        used = np.flatnonzero(local >= 0)
        start, parent = local == 0, trie.check
        mine = local > 0  # a start is the root, or owned where the segment before ends
        mine[on_first[:shared]] = False
        leaf = mine.copy()
        leaf[parent[used[~start[used]]]] = False
        more = t.column("more").to_numpy(zero_copy_only=False)
        leaf[state[own[more[own]]]] = False  # goes on in another segment
        if goes_on:
            leaf[state[hi]] = False
        kids = np.zeros(m, np.int64)
        np.add.at(kids, parent[np.flatnonzero(mine)], 1)
        leaves, weight, once = leaf.astype(np.int64), count * byte, np.where(mine, byte, 0)
        for d in range(int(size[own].max()) - 1, 0, -1):  # from the deepest nodes up
            x = used[local[used] == d]
            for v in (leaves, weight, once):
                np.add.at(v, parent[x], v[x])
        up = np.where(start[used], used, parent[used])
        out = [key_a[used], key_b[used], key_a[up], key_b[up], start[used], level[used] * segment + local[used], count[used], low[used], kids[used],
               leaves[used], weight[used], once[used]]
        return pa.table(out, names=list(_NODE_NAMES))
    return nodes


def _chain_rows(segment: int):
    """Segments with what lies below their ends (leaves, weight, once) to a row per node on them, ends excluded."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            t = pa.Table.from_batches([t])
            paths = _Paths(t.column("turns"))
            sa, sb = _views(t, "sa", "sb")
            ca, cb = paths.chains()
            row = np.repeat(np.arange(len(paths.size)), paths.size)
            place = np.arange(len(row)) - np.repeat(paths.first - paths.offsets[0], paths.size)
            inner = place < segment - 1
            i = row[inner]
            a, b = _key(sa[i], ca[inner]), _key(sb[i], cb[inner])
            a, b = np.concatenate([sa.view(np.int64), a]), np.concatenate([sb.view(np.int64), b])
            which = np.concatenate([np.arange(len(paths.size)), i])
            add = [t.column(k).to_numpy()[which] for k in ("leaves", "weight", "once")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, *add)], names=["a", "b", "leaves", "weight", "once"])
    return rows


def _below(segs: DataFrame, nodes: DataFrame, segment: int) -> DataFrame:
    """What segments deeper down add to the nodes of segments above: a, b, leaves, weight, once.

    All below a start is added along one conversation's path (that of the
    smallest id below): per segment the sum over later starts, then a row per node.
    """
    below = nodes.where("start AND depth > 0").groupBy("a", "b", "depth").agg(*[F.sum(k).alias(k) for k in ("leaves", "weight", "once")])
    long = segs.where(F.col("total") > segment)
    owner = long.where("seg > 0").groupBy(F.col("sa").alias("a"), F.col("sb").alias("b")).agg(F.min("conv_id").alias("conv_id"))
    owned = below.join(owner, ["a", "b"]).select("conv_id", (F.col("depth") / segment).cast("bigint").alias("seg"), "leaves", "weight", "once")
    # sums over the later starts: total minus running sum
    paths = long.join(owned.select("conv_id").distinct(), "conv_id", "left_semi").join(owned, ["conv_id", "seg"], "left")
    sums = prefix_agg(paths.select("conv_id", "seg", "leaves", "weight", "once"), ["conv_id"], "seg", [(f"r_{k}", "sum", k, True) for k in ("leaves", "weight", "once")])
    totals = owned.groupBy("conv_id").agg(*[F.sum(k).alias(f"t_{k}") for k in ("leaves", "weight", "once")])
    later = sums.join(totals, "conv_id").select("conv_id", "seg", *[(F.col(f"t_{k}") - F.coalesce(f"r_{k}", F.lit(0))).alias(k) for k in ("leaves", "weight", "once")])
    rows = long.select("conv_id", "seg", "turns", "sa", "sb").join(later.where("leaves > 0 OR weight > 0 OR once > 0"), ["conv_id", "seg"])
    return rows.mapInArrow(_chain_rows(segment), "a long, b long, leaves long, weight long, once long")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv_id) to lists of ids: at most ``IDS`` of one node a row."""
    for t in batches:
        a, b, ids = (t.column(k).to_numpy() for k in ("a", "b", "conv_id"))
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        cuts = [p for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(a)], strict=True) for p in range(x, y, IDS)]
        text = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(cuts, [*cuts[1:], len(a)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a[cuts]), pa.array(b[cuts]), pa.array(ids[cuts]), pa.array(text, pa.string())], names=["a", "b", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one SHA-256 a node; a node's pieces pass as a stream."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    key, digest = None, None
    for t in batches:
        rows = []
        for a, b, ids in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(3).to_pylist(), strict=True):
            if key == (a, b):
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                rows.append((*key, digest.hexdigest()))
            key, digest = (a, b), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], schema.field(i).type) for i, x in enumerate((*key, digest.hexdigest()))], schema=schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids that end at each node (a, b, conv_id).

    Ids are sorted in ranges and joined to pieces there, so a hot node's ids are
    sorted by many tasks; one task then reads its pieces as a stream.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.repartitionByRange(n, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "a long, b long, first long, ids string")
    return pieces.repartition(n, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def number_turns(conversations: DataFrame) -> DataFrame:
    """Turns with their place from 0 in their conversation: conv_id, pos, n (turns of it), h1, h2, bytes.

    Order: turn (null first), then role, then a hash of role and text.  Rows are
    numbered over ranges of (conv_id, turn), so no conversation is one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(11), text, role).alias("h2"), F.octet_length(text).cast("bigint").alias("bytes"))
    numbered = dense_index(rows, ["conv_id", "turn", "role", "h1", "h2"])
    first = numbered.groupBy("conv_id").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    return numbered.join(first, "conv_id").select("conv_id", (F.col("idx") - F.col("first")).alias("pos"), "n", "h1", "h2", "bytes")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share starts: (conv_id, total) and turns (conv_id, pos, total, h1, h2, bytes).

    Conversation c starts with the first h turns of conversation c - c % 5 and goes
    on with its own after its first h; h is crc32(c) % 9.
    """
    numbered = written(number_turns(conversations), "turns")
    sizes = numbered.where("pos = 0").select("conv_id", "n")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    plan = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("source"))
    given = sizes.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("source"), F.col("n").alias("given"))
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    plan = written(plan.join(given, "source", "left").select("conv_id", "source", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "rebuilt")
    starts = numbered.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < SHARED - 1)).select(F.col("conv_id").alias("source"), "pos", "h1", "h2", "bytes")
    start = plan.join(starts, "source").where("pos < h").select("conv_id", "pos", "total", "h1", "h2", "bytes")
    rest = numbered.drop("n").join(plan, "conv_id").where("pos >= h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "total", "h1", "h2", "bytes")
    return plan.select("conv_id", "total"), start.unionByName(rest)


def conversation_trie(convs: DataFrame, turns: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """Nodes of the prefix trie of conversations.

    ``convs`` (conv_id, total) names every conversation, also one without turns;
    ``turns`` (conv_id, pos, total, h1, h2, bytes) has its turns, told apart by
    (h1, h2).  Returns per node conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.  Without
    conversations there is no node, not even a root.
    """
    segs = written(_segments(turns, segment), "keyed-segments")
    goes_on = F.col("total") > (F.col("seg") + 1) * segment
    distinct = segs.groupBy("seg", "sa", "sb", "ea", "eb", F.size("turns").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.max(goes_on).alias("more"), F.first("turns").alias("turns"))
    ordered = dense_index(distinct.withColumn("path", F.transform("turns", lambda x: x["h1"])).drop("size"), ["seg", "sa", "sb", "path", "ea", "eb"])
    at = F.floor(F.col("idx") / shard)
    place = F.col("idx") % shard
    role = lambda k, r: F.struct((at + k).alias("shard"), F.lit(r).alias("role"))
    roles = F.filter(F.array(role(0, 0), F.when(place == shard - 1, role(1, -1)), F.when((place == 0) & (at > 0), role(-1, 1))), lambda x: x.isNotNull())
    dealt = ordered.drop("path").withColumn("r", F.explode(roles)).select("*", "r.shard", "r.role").drop("r")
    nodes = written(dealt.groupBy("shard").applyInArrow(_guard(_shard_nodes(segment)), _NODE), "trie-shards")

    members = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0")
    zero = F.lit(0).cast("bigint")
    root = members.select(zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), F.lit(True).alias("start"), zero.alias("depth"), "n", "conv_id",
                          zero.alias("kids"), zero.alias("leaves"), zero.alias("weight"), zero.alias("once"))
    below = _below(segs, nodes, segment)
    up = F.max(F.when(~F.col("start"), F.struct("pa", "pb"))).alias("up")
    sums = [F.sum(k).alias(k) for k in ("n", "kids", "leaves", "weight", "once")]
    parts = nodes.unionByName(root).unionByName(below, allowMissingColumns=True)
    merged = written(parts.groupBy("a", "b").agg(up, F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums), "trie")

    last = segs.where(~goes_on)
    empty = convs.where("total = 0").select(zero.alias("a"), zero.alias("b"), "conv_id")
    ends = last.mapInArrow(_ends(segment), "a long, b long, conv_id long").unionByName(empty)
    parents = merged.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    out = merged.join(parents, (F.col("up.pa") == F.col("up_a")) & (F.col("up.pb") == F.col("up_b")), "left")
    out = out.join(ends_digests(ends), ["a", "b"], "left")
    leaves = F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves"))
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                      F.col("kids").alias("n_children"), leaves.cast("bigint").alias("n_leaves"), (F.col("weight") - F.col("once")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def _guard(nodes):
    """A shard that has only the row before it has no nodes."""
    def guarded(t: pa.Table) -> pa.Table:
        if not (t.column("role").to_numpy() == 0).any():
            return pa.table([pa.array([], pa.bool_() if k == "start" else pa.int64()) for k in _NODE_NAMES], names=list(_NODE_NAMES))
        return nodes(t)
    return guarded


def op11_double_array_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt ``conversations``.

    Rows without a conv_id belong to no conversation; equal rows are turns of their
    own; ties of turn are ordered by role, then by hash; other columns are not read;
    c % 5 has the sign of c.
    """
    return conversation_trie(*rebuild(table(spark, sf_dir, "conversations")))


ORACLE = f"""
WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
, own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role) AS l FROM o GROUP BY conv_id)
, h AS (SELECT conv_id, l, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {SHARED} AS h FROM own)
, b AS (SELECT h.conv_id, list_concat(coalesce(s.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN own s ON s.conv_id = h.conv_id - h.conv_id % {GROUP})
, p AS (SELECT conv_id, len(l) AS total, d, l[1:d] AS path, md5(CAST(to_json(l[1:d]) AS VARCHAR)) AS k FROM b, unnest(range(len(l) + 1)) AS u(d))
, n AS (SELECT k, d, any_value(path) AS path, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE total = d) AS ends
        FROM p GROUP BY k, d)
, m AS (SELECT *, CASE WHEN d > 0 THEN md5(CAST(to_json(path[1:d - 1]) AS VARCHAR)) END AS up, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(path[d].text) ELSE 0 END AS saved FROM n)
, c AS (SELECT up AS k, count(*) AS n_children FROM m WHERE up IS NOT NULL GROUP BY up)
, a AS (SELECT md5(CAST(to_json(path[1:x]) AS VARCHAR)) AS k, x AS d, m.saved, c.k IS NULL AS leaf FROM m LEFT JOIN c ON c.k = m.k, unnest(range(m.d + 1)) AS u(x))
, s AS (SELECT k, d, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS n_leaves FROM a GROUP BY k, d)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN s ON s.k = m.k AND s.d = m.d LEFT JOIN c ON c.k = m.k LEFT JOIN m q ON q.k = m.up AND q.d = m.d - 1"""
