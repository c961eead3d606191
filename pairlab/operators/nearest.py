"""Exact k nearest neighbours with pivots and triangle-inequality bounds.

The corpus is cut into cells (rows nearest to the same pivot) and every cell into
blocks of ``block_rows`` rows by distance to its pivot, so a hot cell is many blocks
(shells).  A query with distance ``d`` to a pivot is at least ``d - r`` (``r - d``) away
from every row within (beyond) radius ``r`` of it.  Each query first searches the
blocks around its own shell; its k-th distance there bounds what it still has to
search: in every cell the shells that the bound reaches, which is one range of blocks.

Pivots are a bounded sample (they decide the cost, never the result).  Consecutive
blocks are a slab, which is a file that a task holds.  What is shuffled is the corpus
once, and a query's vector per slab with blocks that it has to search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.text import seeded_hash
from pairlab.operators.retrieve import merge_nearest, nearest_rows
from pairlab.operators.scan import dense_index
from pairlab.session import materialize

#: at most so many pivots; rows of a block (more where a corpus would have over ``MAX_BLOCKS`` blocks)
PIVOTS, BLOCK_ROWS, MAX_BLOCKS = 256, 1024, 1 << 16
#: numbers in the vectors of a slab, at most so many queries of a task, queries routed and searched at once, rows placed by a task
SLAB_VALUES, CHUNK, ROUTED, ASKED, PLACED = 1 << 22, 1 << 13, 256, 2048, 1 << 13
#: rounding of a squared distance, as a share of the squared lengths it comes from
_ROUNDING = 1e-12


@dataclass
class Neighbours:
    """``rows``: (query id, neighbour id, dist, rank); ``searched``: (query, slab, n_rows) of both rounds, ``n_rows`` in the blocks searched."""
    rows: DataFrame
    searched: DataFrame
    n_pivots: int
    n_queries: int
    n_corpus: int

    def report(self) -> DataFrame:
        """One row: distances computed (to pivots and to rows) and those of a search without bounds."""
        return self.searched.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_row_distances")).select(
            "n_row_distances", F.lit(self.n_pivots * (self.n_queries + self.n_corpus)).cast("bigint").alias("n_pivot_distances"),
            F.lit(self.n_queries * self.n_corpus).cast("bigint").alias("n_all_distances"))


def _stack(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size != size[0]).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def _plain(column: pa.Array) -> np.ndarray:
    a = column.to_numpy(zero_copy_only=False)
    return a.astype(str) if a.dtype == object else a


def _to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((v - p) ** 2).sum(axis=1) for p in pivots], axis=1))


def _cells(pivots: np.ndarray):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _to_pivots(_stack(b.column(1)), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])],
                                                 names=["cid", "vec", "ckey", "cell", "radius"])
    return cells


def _edges(shells: pa.Table) -> dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per cell: the place of its first block, and its blocks' least and largest radius and rows."""
    cell, near, far, n = (shells.column(k).to_numpy() for k in ("cell", "near", "far", "n_rows"))
    out = {}
    for c in np.unique(cell):
        lo, hi = np.searchsorted(cell, [c, c + 1])
        out[int(c)] = int(lo), near[lo:hi], far[lo:hi], n[lo:hi]
    return out


def _first_blocks(pivots: np.ndarray, shells, k: int):
    """For each query the blocks (places from, to) of its nearest cell around its own shell, until those have more than ``k`` rows."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(shells.value)
        held = np.array(sorted(edges))
        for b in batches:
            if not b.num_rows or not len(held):
                continue
            d = _to_pivots(_stack(b.column(1)), pivots[held])
            start, stop = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            for i, c in enumerate(d.argmin(axis=1).tolist()):
                first, _, far, rows = edges[int(held[c])]
                at = min(int(np.searchsorted(far, d[i, c])), len(rows) - 1)
                lo, hi, found = at, at + 1, int(rows[at])
                while found <= k and (lo > 0 or hi < len(rows)):
                    if hi < len(rows):
                        found += int(rows[hi])
                        hi += 1
                    if lo > 0:
                        lo -= 1
                        found += int(rows[lo])
                start[i], stop[i] = first + lo, first + hi
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start), pa.array(stop)], names=[*b.schema.names, "start", "stop"])
    return route


def _ranges(n: int, width: int, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """``n`` rows of ``width`` flags, set in the ranges given of each row (those of a row do not overlap)."""
    step = np.zeros((n, width + 1), np.int8)
    np.add.at(step, (row, lo), 1)
    np.add.at(step, (row, hi), -1)
    return np.cumsum(step[:, :width], axis=1, dtype=np.int8).view(bool)


def _reached(v: np.ndarray, pivots: np.ndarray, edges, bound: np.ndarray, n_blocks: int) -> np.ndarray:
    """Query x block: whether the query's bound reaches into the block (no bound: everywhere)."""
    held = np.array(sorted(edges))
    d = _to_pivots(v, pivots[held])
    scale = 2 * (np.sqrt((v * v).sum(axis=1)) + d.max(axis=1)) ** 2 + 1
    reach = np.sqrt(np.where(np.isnan(bound), np.inf, bound) + _ROUNDING * scale)
    row, start, stop = [], [], []
    for j, c in enumerate(held.tolist()):
        first, near, far, _ = edges[c]
        lo = np.searchsorted(np.maximum.accumulate(far), d[:, j] - reach)  # shells wholly within are too near
        hi = np.searchsorted(near, d[:, j] + reach, side="right")
        some = np.flatnonzero(hi > lo)
        row.append(some)
        start.append(first + lo[some])
        stop.append(first + hi[some])
    return _ranges(len(v), n_blocks, *(np.concatenate(x) for x in (row, start, stop)))


def _tiles(pivots: np.ndarray, shells, others: bool):
    """Queries to the slabs with blocks to search: their first blocks, or (with a bound) all ``others`` that it reaches."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(shells.value)
        size, slab = (shells.value.column(k).to_numpy() for k in ("n_rows", "slab"))
        cuts = np.flatnonzero(np.diff(slab, prepend=-1, append=-1))
        for b in (whole.slice(i, ROUTED) for whole in batches for i in range(0, whole.num_rows, ROUTED)):
            rows = np.arange(b.num_rows)
            wanted = first = _ranges(b.num_rows, len(size), rows, *(b.column(k).to_numpy() for k in ("start", "stop")))
            bound = b.column("bound").to_numpy(zero_copy_only=False).astype("float64")
            if others:
                wanted = _reached(_stack(b.column("vec")), pivots, edges, bound, len(size)) & ~first
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at = np.flatnonzero(wanted[:, lo:hi].any(axis=1))
                if len(at):
                    here = wanted[at, lo:hi]
                    count = here.sum(axis=1)
                    blocks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array((np.nonzero(here)[1] + lo).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in ("qid", "vec", "qkey", "chunk", "bound")), pa.array(np.full(len(at), slab[lo], np.int32)),
                                                      blocks, pa.array(here @ size[lo:hi])], names=["qid", "vec", "qkey", "chunk", "bound", "slab", "blocks", "n_rows"])
    return route


def _read_slab(paths: list[str], shells: pa.Table):
    """(ids as they are, ids to sort by, keys, vectors) of a slab's rows in order of their blocks, and where each block starts."""
    from pyarrow import fs, parquet
    parts = []
    for path in paths:
        store, place = fs.FileSystem.from_uri(path)
        with store.open_input_file(place) as f:
            parts += [b for b in parquet.ParquetFile(f).iter_batches(columns=["block", "cid", "vec", "ckey"]) if b.num_rows]
    at = np.searchsorted(shells.column("block").to_numpy(), np.concatenate([b.column("block").to_numpy() for b in parts]))
    order = np.argsort(at, kind="stable")
    cid = pa.concat_arrays([b.column("cid") for b in parts]).take(pa.array(order))
    keys = np.concatenate([b.column("ckey").to_numpy(zero_copy_only=False).astype(str) for b in parts])[order]
    return cid, _plain(cid), keys, np.concatenate([_stack(b.column("vec")) for b in parts])[order], np.searchsorted(at[order], np.arange(shells.num_rows + 1))


def _search(paths: dict[int, list[str]], shells, k: int):
    """Queries with blocks of one slab to their ``k`` nearest rows in those blocks."""
    def nearest(v, keys, bound, blocks, slab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        _, order, ckey, held, starts = slab
        row = np.repeat(np.arange(len(v)), np.diff(blocks.offsets.to_numpy()))
        block = blocks.flatten().to_numpy()
        by_block = np.argsort(block, kind="stable")
        row, block = row[by_block], block[by_block]
        bound, found, n_new = np.where(np.isnan(bound), np.inf, bound), [], 0
        for lo, hi in zip(cuts := np.flatnonzero(np.diff(block, prepend=-1)), [*cuts[1:], len(block)], strict=True):
            c = slice(*starts[[block[lo], block[lo] + 1]])
            asked = row[lo:hi]
            free = np.isinf(bound[asked])
            for mine in (asked[free], asked[~free]):
                if len(mine):
                    r, col, dist = nearest_rows(v[mine], held[c], order[c], keys[mine], ckey[c], k, bound[mine])
                    found.append((mine[r], col + c.start, dist, order[c][col]))
                    n_new += len(r)
            if n_new > 2 * k * len(v) or free.any():  # what was found so far bounds the blocks to come
                best = merge_nearest(found, k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(v)) == k)
                last = np.searchsorted(best[0], full, side="right") - 1
                bound[full] = np.minimum(bound[full], best[2][last])
                found, n_new = [best], 0
        return merge_nearest(found, k)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in (whole.slice(i, ASKED) for whole in batches for i in range(0, whole.num_rows, ASKED)):
            if b.column("slab")[0].as_py() != now:
                now = b.column("slab")[0].as_py()
                held = _read_slab(paths[now], shells.value)
            row, col, dist, _ = nearest(_stack(b.column("vec")), b.column("qkey").to_numpy(zero_copy_only=False).astype(str),
                                        b.column("bound").to_numpy(zero_copy_only=False).astype("float64"), b.column("blocks"), held)
            yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(row)), held[0].take(pa.array(col)), pa.array(dist)], names=["query_id", "neighbor_id", "dist"])
    return search


def knn_join_pivots(queries: DataFrame, corpus: DataFrame, *, k: int = 4, vec: str = "embedding", qid: str = "query_id",
                    cid: str = "neighbor_id", qkey: str | None = None, ckey: str | None = None, pivots: int = PIVOTS,
                    block_rows: int = BLOCK_ROWS, seed: int = 0) -> Neighbours:
    """Exact k nearest corpus rows (squared L2) for every query, ties by id, as ``knn_join`` gives them.

    Ids may be of any type and name one row.  With ``qkey`` and ``ckey`` pairs of equal
    keys are excluded.  Rows without a vector have no neighbours and are none.
    A query whose first blocks have fewer than k rows for it searches every
    block.  Vectors without clusters are searched almost whole, which is the work of
    ``knn_join``, in tasks of at most ``CHUNK`` queries and one slab.  The pivots and one row per block (its radii; at most
    ``MAX_BLOCKS`` and one per pivot) reach the driver and the tasks; intermediate
    tables are written to the shared folder.
    """
    spark = corpus.sparkSession
    excl = qkey is not None and ckey is not None
    q_type, c_type = queries.schema[qid].dataType, corpus.schema[cid].dataType
    doubles = lambda df: df.filter(F.col(vec).isNotNull())
    q = materialize(doubles(queries).select(F.col(qid).alias("qid"), F.col(vec).cast("array<double>").alias("vec"),
                                            (F.col(qkey) if excl else F.lit("q")).cast("string").alias("qkey")), "nearest_queries")
    c = materialize(doubles(corpus).select(F.col(cid).alias("cid"), F.col(vec).cast("array<double>").alias("vec"),
                                           (F.col(ckey) if excl else F.lit("c")).cast("string").alias("ckey")), "nearest_corpus")
    n_queries, n_corpus = q.count(), c.count()
    result = T.StructType([T.StructField("query_id", q_type), T.StructField("neighbor_id", c_type), T.StructField("dist", T.DoubleType())])
    sample = c.orderBy(seeded_hash("cid", seed=seed), "cid").limit(max(1, min(pivots, int(n_corpus ** 0.5)))).collect()
    if not sample:
        none = spark.createDataFrame([], result).withColumn("rank", F.lit(0))
        return Neighbours(none.withColumnsRenamed({"query_id": qid, "neighbor_id": cid}), spark.createDataFrame([], "n_rows long"), 0, n_queries, 0)
    points = np.array([r.vec for r in sample], dtype="float64")
    celled = T.StructType([*c.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])
    placed = dense_index(c.repartition(-(-n_corpus // PLACED)).mapInArrow(_cells(points), celled), ["cell", "radius", "cid"], name="at")
    start = placed.groupBy("cell").agg(F.min("at").alias("first"))
    # a block: consecutive rows of one cell by radius; a slab: consecutive blocks
    block_rows = max(block_rows, -(-n_corpus // MAX_BLOCKS))
    slab_rows = max(1, SLAB_VALUES // max(1, points.shape[1]))
    n_slabs = -(-n_corpus // slab_rows)
    blocks = placed.join(start, "cell").withColumn("shell", F.floor((F.col("at") - F.col("first")) / block_rows))
    blocks = blocks.withColumn("slab", F.floor((F.col("first") + F.col("shell") * block_rows) / slab_rows).cast("int"))
    blocks = materialize(blocks.select((F.col("cell").cast("bigint") * F.lit(1 << 40) + F.col("shell")).alias("block"), "cell", "radius", "cid", "vec", "ckey", "slab")
                         .repartitionById(n_slabs, "slab"), "nearest_blocks", by=["slab"])
    table = blocks.groupBy("block", "cell", "slab").agg(F.min("radius").alias("near"), F.max("radius").alias("far"), F.count(F.lit(1)).alias("n_rows")).toArrow()
    shells = spark.sparkContext.broadcast(table.combine_chunks().sort_by("block"))
    paths: dict[int, list[str]] = {}
    for path in blocks.inputFiles():
        paths.setdefault(int(path.rsplit("/slab=", 1)[1].split("/")[0]), []).append(path)

    # a task: the queries of one chunk that have blocks of one slab to search
    n_chunks = max(-(-n_queries // CHUNK), min(-(-2 * spark.sparkContext.defaultParallelism // n_slabs), -(-n_queries // ROUTED)), 1)
    number = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    q = q.repartition(n_chunks).withColumn("chunk", F.spark_partition_id())
    tiled = T.StructType([*q.schema.fields, T.StructField("bound", T.DoubleType()), T.StructField("slab", T.IntegerType()),
                          T.StructField("blocks", T.ArrayType(T.IntegerType())), T.StructField("n_rows", T.LongType())])

    def search(tiles: DataFrame) -> DataFrame:
        dealt = tiles.repartitionById(n_slabs * n_chunks, F.col("slab") * n_chunks + F.col("chunk"))
        return dealt.mapInArrow(_search(paths, shells, k), result)

    nearest = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "neighbor_id"))
    first = materialize(q.mapInArrow(_first_blocks(points, shells, k), T.StructType([*q.schema.fields, *number.fields])), "nearest_first")
    asked = materialize(first.withColumn("bound", F.lit(None).cast("double")).mapInArrow(_tiles(points, shells, False), tiled), "nearest_asked")
    found = materialize(search(asked).withColumn("rank", nearest).filter(F.col("rank") <= k), "nearest_found")
    bound = found.filter(F.col("rank") == k).select(F.col("query_id").alias("qid"), F.col("dist").alias("bound"))
    others = materialize(first.join(bound, "qid", "left").mapInArrow(_tiles(points, shells, True), tiled), "nearest_others")
    both = found.drop("rank").unionByName(search(others))
    best = both.withColumn("rank", nearest).filter(F.col("rank") <= k)
    searched = asked.select("qid", "slab", "n_rows").unionByName(others.select("qid", "slab", "n_rows"))
    return Neighbours(best.withColumnsRenamed({"query_id": qid, "neighbor_id": cid}), searched, len(sample), n_queries, n_corpus)
