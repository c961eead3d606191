"""RETR: nearest training examples by embedding, assembled into few-shot prompts."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.text import canonical_newlines, fill_template
from pairlab.operators.scan import keep_first
from pairlab.operators.texts import transform_texts
from pairlab.session import materialize

# Few-shot prompt templates and the separator between examples.
EXAMPLE_TEMPLATE = "# slower version:\n\n{src_code}\n\n\n# optimized version of the same code:\n\n{tgt_code}"
QUERY_TEMPLATE = "{examples}\n\n\n\n\n# slower version:\n\n{src_code}\n\n# optimized version of the same code:"
EXAMPLE_SEPARATOR = "\n\n\n\n\n"

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def distinct_sources(df: DataFrame, col: str = "src_code") -> DataFrame:
    """Distinct texts, keyed by their hash (the text rides along once)."""
    return keep_first(df.select(F.sha2(F.col(col), 256).alias("text_hash"), col), ["text_hash"], ["text_hash"])


def letter_counts(text) -> "F.Column":
    """Default encoder: counts of the letters a-z in the lower-cased text
    (JVM-side expression, integer valued, so distances are exact)."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(ch), F.lit("")))).cast("double")
                     for ch in LETTERS])


#: texts given to ``gram_sums`` at once, and characters whose grams it holds at once
GRAM_TEXTS, GRAM_CHARS = 256, 1 << 19


def _gram_signs(points: np.ndarray, at: np.ndarray, n: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of the grams that start at ``at``; each distinct gram is hashed once."""
    code = points[at].astype(np.uint64)
    for i in range(1, n):
        if i > 2:  # two more code points no longer fit beside the code: number the distinct codes
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
        code = (code << np.uint64(21)) | points[at + i]
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    digests = [md5(points[i:i + n].tobytes().decode("utf-32-le").encode()).digest()[:4] for i in at[first].tolist()]
    number = np.frombuffer(b"".join(digests), dtype=">u4").astype(np.int64)
    return (number % dims)[which], np.where(number // dims % 2 == 0, 1.0, -1.0)[which]


def gram_sums(texts: list[str], n: int, dims: int) -> np.ndarray:
    """Signed sums of each text's grams: a row per text."""
    sums = np.zeros((len(texts), dims))
    held, rows, size = [], [], 0

    def add() -> None:
        points, lengths = np.concatenate(held), np.array([len(p) for p in held])
        ends = np.cumsum(lengths)
        # a gram lies within one window
        at = np.flatnonzero(np.arange(len(points)) + n <= np.repeat(ends, lengths))
        bucket, sign = _gram_signs(points, at, n, dims)
        row = np.repeat(np.array(rows), lengths)[at]
        np.add(sums, np.bincount(row * dims + bucket, weights=sign, minlength=sums.size).reshape(sums.shape), out=sums)

    for i, t in enumerate(texts):
        for lo in range(0, len(t) - n + 1, GRAM_CHARS):
            window = np.frombuffer(t[lo:lo + GRAM_CHARS + n - 1].encode("utf-32-le"), dtype="<u4")
            held.append(window)
            rows.append(i)
            size += len(window)
            if size >= GRAM_CHARS:
                add()
                held, rows, size = [], [], 0
    if held:
        add()
    return sums


def hashed_ngrams(df: DataFrame, text: str, *, n: int = 3, dims: int = 64, out: str = "embedding") -> DataFrame:
    """F12 default of the source's kind: signed feature hashing of character n-grams.

    Every run of ``n`` characters of the lower-cased text adds +1 or -1 to one of
    ``dims`` buckets, both taken from its MD5 (so any SQL engine can repeat it).  A
    text shorter than ``n`` is the zero vector, a NULL text has none.  Distinct texts
    are encoded once, in Arrow batches; a long text is cut into overlapping windows,
    so neither its grams nor a copy of it per gram are ever held.
    """
    hashed = df.withColumn("_h", F.sha2(F.col(text), 256))
    uniq = hashed.filter(F.col(text).isNotNull()).groupBy("_h").agg(F.first(text).alias("_t")).select("_h", F.lower("_t").alias("_t"))
    schema = T.StructType([T.StructField("_h", T.StringType()), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for at in range(0, b.num_rows, GRAM_TEXTS):
                part = b.slice(at, GRAM_TEXTS)
                sums = gram_sums(part.column(1).to_pylist(), n, dims)
                ends = pa.array(np.arange(0, sums.size + 1, dims, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], names=["_h", out])

    return hashed.join(uniq.mapInArrow(run, schema), "_h", "left").drop("_h")


def encode_text(df: DataFrame, text: str, *, encoder: Callable[[list[str]], np.ndarray] | None = None,
                out: str = "embedding", batch: int = 256, method: str = "letters") -> DataFrame:
    """embed a text column.

    Without ``encoder``: ``letter_counts``, or ``hashed_ngrams`` for ``method="ngrams"``.
    With ``encoder`` (list of texts -> 2-D array, loaded once per worker) every
    distinct text is encoded once in Arrow batches and joined back by hash; a NULL
    text has no vector.
    """
    if encoder is None:
        return hashed_ngrams(df, text, out=out) if method == "ngrams" else df.withColumn(out, letter_counts(text))

    def encode(texts: list[str]) -> list[list[float]]:
        parts = [np.asarray(encoder(texts[i:i + batch]), dtype="float64") for i in range(0, len(texts), batch)]
        return [row.tolist() for part in parts for row in part]

    return transform_texts(df, text, encode, out=out, to=T.ArrayType(T.DoubleType())).rows


def nearest_rows(q: np.ndarray, c: np.ndarray, cid: np.ndarray, qkey: np.ndarray, ckey: np.ndarray, k: int,
                 bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, corpus row, distance) of each query's k nearest corpus rows, ties by id.

    The matrix product finds the candidates (with a margin for its rounding, which
    depends on the shapes); their distances are then taken by differences, so
    equal vectors have equal distances wherever they lie.  With a ``bound`` per query
    (a distance that k rows found elsewhere keep) farther rows are left out.
    """
    long_q, long_c = (q * q).sum(1), (c * c).sum(1)
    dist = q @ c.T
    dist *= -2.0
    dist += long_c  # the distance but for the query's length
    # pairs of equal keys, by the place of a query's key among the sorted keys
    by_key = np.argsort(ckey, kind="stable")
    lo, n = np.searchsorted(ckey, qkey, sorter=by_key), np.searchsorted(ckey, qkey, side="right", sorter=by_key)
    n -= lo
    own = np.repeat(np.arange(len(q)), n)
    dist[own, by_key[np.arange(len(own)) - np.repeat(np.cumsum(n) - n - lo, n)]] = np.inf
    kk = min(k, dist.shape[1])
    if bound is None or not np.isfinite(bound).all():
        limit = np.partition(dist, kk - 1, axis=1)[:, kk - 1]
    else:
        limit = bound - long_q
    limit = limit + 1e-12 * (long_q + long_c.max())
    row, col = np.nonzero(dist <= limit[:, None])
    there = np.isfinite(dist[row, col])
    row, col = row[there], col[there]
    value = ((q[row] - c[col]) ** 2).sum(axis=1)
    order = np.lexsort((cid[col], value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < kk
    return row[keep], col[keep], value[keep]


def _vectors(batch, column: str) -> np.ndarray:
    return np.stack(batch.column(column).to_numpy(zero_copy_only=False)).astype("float64")


def _ids(batch, column: str) -> np.ndarray:
    a = batch.column(column).to_numpy(zero_copy_only=False)
    return a.astype(str) if a.dtype == object else a


#: distances that ``knn_join`` holds at once, corpus rows of its blocks, rows of a file of either side, distances of a task
KNN_CELLS, KNN_ROWS, KNN_FILE_ROWS, KNN_SHARE = 1 << 21, 1 << 13, 1 << 16, 1 << 31


def merge_nearest(parts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, place in the block's task, distance, id) lists merged to each query's k nearest, ties by id."""
    row, col, dist, cid = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((cid, dist, row))
    row, col, dist, cid = row[order], col[order], dist[order], cid[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[keep], col[keep], dist[keep], cid[keep]


def knn_join(queries: DataFrame, corpus: DataFrame, *, k: int = 4, vec: str = "embedding",
             qid: str = "query_id", cid: str = "neighbor_id", qkey: str | None = None,
             ckey: str | None = None, q_block_rows: int = 2048, corpus_partitions: int | None = None) -> DataFrame:
    """Exact k nearest corpus rows (squared L2) for every query, ties by id.

    Both sides are written once to the shared folder, in files of at most
    ``KNN_FILE_ROWS`` rows (the corpus in ``corpus_partitions`` parts; as it comes by
    default).  A piece of work is a corpus file and a query file; there are as many
    tasks as the pieces ask for, however few parts the corpus has.  A task holds one
    corpus file and reads the queries in blocks of at most ``q_block_rows``, takes one
    block of distances at a time (``KNN_CELLS``) and returns its k nearest for each
    query; ``row_number() <= k`` merges the pieces.  So neither side's vectors are
    shuffled for the search, but k narrow rows per query and corpus file.  The work
    is queries x corpus by nature.

    Ids may be of any type.  When ``qkey`` and ``ckey`` are given, pairs with
    equal keys are excluded (leave-one-out).  Rows without a vector have no
    neighbours and are none.
    """
    spark = corpus.sparkSession
    excl = qkey is not None and ckey is not None
    q_type, c_type = queries.schema[qid].dataType, corpus.schema[cid].dataType
    q = queries.filter(F.col(vec).isNotNull()).select(
        F.col(qid).alias("qid"), F.col(vec).cast("array<double>").alias("vec"), (F.col(qkey) if excl else F.lit("q")).cast("string").alias("qkey"))
    c = corpus.filter(F.col(vec).isNotNull()).select(
        F.col(cid).alias("cid"), F.col(vec).cast("array<double>").alias("vec"), (F.col(ckey) if excl else F.lit("c")).cast("string").alias("ckey"))
    if corpus_partitions:
        c = c.repartition(corpus_partitions, "cid")
    q, c = (materialize(d, name, maxRecordsPerFile=KNN_FILE_ROWS) for d, name in ((q, "knn_queries"), (c, "knn_corpus")))
    work = [(i, *pair) for i, pair in enumerate(product(sorted(c.inputFiles()), sorted(q.inputFiles())))]
    wanted = max(2 * spark.sparkContext.defaultParallelism, -(-q.count() * c.count() // KNN_SHARE))
    tasks = spark.createDataFrame(work, "at long, corpus string, queries string").repartitionByRange(max(1, min(wanted, len(work))), "at")
    block_rows = max(1, min(q_block_rows, KNN_CELLS // KNN_ROWS))

    def blocks(path, rows):
        from pyarrow import fs, parquet
        store, place = fs.FileSystem.from_uri(path)
        with store.open_input_file(place) as f:
            yield from (b for b in parquet.ParquetFile(f).iter_batches(batch_size=rows) if b.num_rows)

    def search(batches):
        import pyarrow as pa
        now, held, own = None, [], None
        for of, asked in ((x, y) for b in batches for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            if of != now:
                now, held = of, [(b.column("cid"), _vectors(b, "vec"), _ids(b, "cid"), _ids(b, "ckey")) for b in blocks(of, KNN_ROWS)]
                own = pa.concat_arrays([h[0] for h in held]) if held else None
            for block in blocks(asked, block_rows) if held else ():
                v, keys, at, best, bound = _vectors(block, "vec"), _ids(block, "qkey"), 0, None, None
                for _, vectors, ids, ckeys in held:
                    row, col, dist = nearest_rows(v, vectors, ids, keys, ckeys, k, bound)
                    best = merge_nearest([*([best] if best else []), (row, col + at, dist, ids[col])], k)
                    bound = np.full(len(v), np.inf)
                    full = np.bincount(best[0], minlength=len(v)) == k
                    np.maximum.at(worst := np.full(len(v), -np.inf), best[0], best[2])
                    bound[full] = worst[full]
                    at += len(ids)
                row, col, dist, _ = best
                yield pa.RecordBatch.from_arrays([block.column("qid").take(pa.array(row)), own.take(pa.array(col)), pa.array(dist)],
                                                 names=["query_id", "neighbor_id", "dist"])

    schema = T.StructType([T.StructField("query_id", q_type), T.StructField("neighbor_id", c_type), T.StructField("dist", T.DoubleType())])
    part = tasks.mapInArrow(search, schema)
    w = Window.partitionBy("query_id").orderBy("dist", "neighbor_id")
    out = part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.withColumnRenamed("query_id", qid).withColumnRenamed("neighbor_id", cid)


def best_pair_per_source(pairs: DataFrame, *, code: str = "src_code", speedup: str = "speedup",
                         ordinal: str = "src_id") -> DataFrame:
    """The highest-speedup pair for every distinct slow program; on a tie
    the first (smallest ordinal) wins.  Grouped by the code's hash."""
    d = pairs.withColumn("code_hash", F.sha2(F.col(code), 256))
    neg = F.when(F.isnan(F.col(speedup)), F.lit(None)).otherwise(-F.col(speedup))
    return keep_first(d, ["code_hash"], [neg, F.col(ordinal)])


def pair_prompt(src: str = "src_code", tgt: str = "tgt_code") -> "F.Column":
    """One worked example: slow program, then its optimized version (newline runs collapsed)."""
    return fill_template(EXAMPLE_TEMPLATE, {"src_code": canonical_newlines(F.col(src), 1),
                                            "tgt_code": canonical_newlines(F.col(tgt), 1)})


def lookup_best_pair(neighbours: DataFrame, best: DataFrame, *, cid: str = "neighbor_id",
                     best_id: str = "src_id") -> DataFrame:
    """Neighbour -> its best pair and prompt (rank kept)."""
    b = best.select(F.col(best_id).alias(cid), pair_prompt().alias("prompt"))
    return neighbours.join(b, cid)


def fewshot_prompt(neighbours: DataFrame, queries: DataFrame, *, qid: str = "query_id",
                   code: str = "src_code") -> DataFrame:
    """k example prompts, nearest last, separated by blank lines, then the query.

    The list per query holds at most k entries (bounded collect).
    """
    per_q = neighbours.groupBy(qid).agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank"), F.col("prompt"))), asc=False).alias("_ex"),
        F.count(F.lit(1)).alias("n_examples"))
    joined = F.array_join(F.transform("_ex", lambda x: x["prompt"]), EXAMPLE_SEPARATOR)
    return queries.join(per_q, qid).select(
        qid, "n_examples",
        fill_template(QUERY_TEMPLATE, {"examples": joined, "src_code": F.col(code)}).alias("input"))


def retrieve_prompts(queries: DataFrame, pairs: DataFrame, *, k: int = 4, encoder=None,
                     qid: str = "src_id", code: str = "src_code", method: str = "letters", pivots: bool = False) -> DataFrame:
    """Composed RETR job: U2/A12 -> F12 -> J7 -> J10 -> F6.

    The corpus is one row per distinct slow program of ``pairs`` (its best
    pair); a query never retrieves its own program text.  ``pivots`` searches with
    bounds (the same neighbours; fewer distances where programs cluster).
    """
    best = best_pair_per_source(pairs)
    corpus = encode_text(best.select(F.col("src_id").alias("neighbor_id"), "code_hash", code), code,
                         encoder=encoder, method=method)
    q = encode_text(queries.select(F.col(qid).alias("query_id"), code,
                                   F.sha2(F.col(code), 256).alias("q_hash")), code, encoder=encoder, method=method)
    if pivots:
        from pairlab.operators.nearest import knn_join_pivots
        nn = knn_join_pivots(q, corpus, k=k, qkey="q_hash", ckey="code_hash").rows
    else:
        nn = knn_join(q, corpus, k=k, qkey="q_hash", ckey="code_hash")
    nb = lookup_best_pair(nn, best)
    return fewshot_prompt(nb, queries.select(F.col(qid).alias("query_id"), code))
