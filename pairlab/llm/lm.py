"""Language-model scoring with a weighted backoff automaton.

States are contexts (the last words, down to the empty context, the root).  A
state has an arc for every word that followed it in training, weighted with the
smoothed log probability, and a failure arc to its next shorter context,
weighted with the mass left for unseen words.  Reading a text from left to right
carries the state along and adds the weights of the arcs and failure arcs taken.

Smoothing is Bayesian (Dirichlet): with ``c`` training counts,

    P(w | h) = (c(hw) + mu * P(w | h')) / (c(h) + mu),   h' = h without its first word,

and at the root P(w) = (c(w) + 1/2) / (N + (V + 1) / 2).  So the failure weight of
``h`` is mu / (c(h) + mu), and a context never seen fails at no cost.

The automaton of a corpus does not fit on a machine, so it is never built in one
place.  Documents are cut into blocks; a block asks for the counts of its
distinct n-grams, keyed by hash range; every hash range is counted by one task
over all blocks and answers each block with one number per n-gram asked; then a
block has the part of the automaton that its documents can reach.  Counts cover
all training documents, without a cut-off; a frequent n-gram costs one request
per block.  Requests and answers are binary arrays, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import words as W
from pairlab.llm.base import shared_path, table
from pairlab.llm.files import open_in

ORDER = 2
#: prior strength of a context, in observations
STRENGTH = 100.0
#: bytes of text in a block; n-grams of a bucket that are merged at once
BLOCK_BYTES, MERGED = 8 << 20, 1 << 18

_START, _END = W.mix64(np.array([0x5354415254, 0x454E44], dtype=np.uint64))

_BLOCKS = "block long, ids binary, words binary, lengths binary, doc_ids array<long>, train array<boolean>"
_ASK = "bucket int, block long, level int, grams binary, seen binary"
_ANSWER = "bucket int, block long, level int, counts binary, n_words long, n_tokens long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, train, text) to blocks of local word ids."""
    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 32
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        at = 0
        lengths = np.diff(W.utf8(b.column(2))[1]).cumsum()
        while at < b.num_rows:
            before = lengths[at - 1] if at else 0
            n = int(np.searchsorted(lengths, before + BLOCK_BYTES - size, side="left")) + 1
            n = min(max(n, at + 1), b.num_rows)
            held.append(b.slice(at, n - at))
            size += int(lengths[n - 1] - before)
            at = n
            if size >= BLOCK_BYTES:
                yield _block(held, block)
                held, size, block = [], 0, block + 1
    if held:
        yield _block(held, block)


def _block(held: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    hashes, lengths = [], []
    for w in W.scan(t.column(2)):
        hashes.append(w.hash)
        lengths.append(w.count)
    words, ids = np.unique(np.concatenate(hashes), return_inverse=True)
    row = {"block": [block], "ids": [ids.astype(np.uint32).tobytes()], "words": [words.tobytes()],
           "lengths": [np.concatenate(lengths).astype(np.int64).tobytes()], "doc_ids": [t.column(0).combine_chunks().to_pylist()],
           "train": [t.column(1).combine_chunks().to_pylist()]}
    return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("words", pa.binary()), ("lengths", pa.binary()),
                                                             ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_()))]))


class _Stream:
    """The symbols of a block: per document a start, its words, an end."""

    def __init__(self, ids: bytes, words: bytes, lengths: bytes, train: list[bool]):
        word = np.concatenate([np.frombuffer(words, np.uint64), [_START, _END]])
        local = np.frombuffer(ids, np.uint32)
        n = np.frombuffer(lengths, np.int64)
        self.first = np.concatenate([[0], np.cumsum(n + 2)])
        symbol = np.empty(self.first[-1], np.int64)
        inner = np.ones(len(symbol), dtype=bool)
        inner[self.first[:-1]] = inner[self.first[1:] - 1] = False
        symbol[inner] = local
        symbol[self.first[:-1]] = len(word) - 2
        symbol[self.first[1:] - 1] = len(word) - 1
        self.symbol = symbol
        self.hash = word[symbol]
        self.place = np.arange(len(symbol)) - np.repeat(self.first[:-1], n + 2)
        self.train = np.repeat(np.array(train, dtype=bool), n + 2)

    def grams(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, positions, index of each position's gram) of the n-grams of ``level`` symbols, by their last position."""
        at = np.flatnonzero(self.place >= level - 1)
        h = W.window_hash(self.hash, level)[at - (level - 1)] if level > 1 else W.mix64(self.hash[at])
        grams, index = np.unique(h, return_inverse=True)
        return grams, at, index


def _ask(order: int, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s = _Stream(r["ids"], r["words"], r["lengths"], r["train"])
                for level in range(1, order + 1):
                    grams, at, index = s.grams(level)
                    seen = np.bincount(index[s.train[at]], minlength=len(grams))
                    edge = _edges(grams, buckets)
                    full = np.flatnonzero(np.diff(edge))
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array(full, pa.int32()), "block": pa.array([r["block"]] * len(full), pa.int64()), "level": pa.array([level] * len(full), pa.int32()),
                        "grams": [_planes(np.diff(grams[edge[i]:edge[i + 1]], prepend=np.uint64(0))) for i in full],
                        "seen": [_planes(seen[edge[i]:edge[i + 1]]) for i in full]})
    return ask


def _edges(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the hash ranges in sorted grams."""
    cut = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(grams, cut), [len(grams)]])


def _planes(counts: np.ndarray) -> bytes:
    """Numbers as byte planes, the low bytes first (small counts compress to a byte each, steps between sorted hashes to five or six)."""
    return np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def _answer(t: pa.Table) -> pa.Table:
    """All requests of a bucket to answers: the training count of each n-gram asked.

    Requests are sorted arrays; they are merged a part of the bucket's range at a
    time, so beside requests and answers only one part is held.
    """
    level = t.column("level").to_numpy()
    bucket = t.column("bucket")[0].as_py()
    rows = {"bucket": [], "block": [], "level": [], "counts": [], "n_words": [], "n_tokens": []}
    for k in np.unique(level):
        part = t.filter(pa.array(level == k))
        asked = [np.cumsum(_unplanes(x.as_py()), dtype=np.uint64) for x in part.column("grams")]
        seen = [_unplanes(x.as_py()).astype(np.uint32) for x in part.column("seen")]
        size = sum(map(len, asked))
        least, most = min(int(a[0]) for a in asked), max(int(a[-1]) for a in asked)
        parts = -(-size // MERGED)
        bounds = np.array([least + (most - least) * i // parts for i in range(1, parts)], dtype=np.uint64)
        cuts = [np.concatenate([[0], np.searchsorted(a, bounds), [len(a)]]) for a in asked]
        counts = [np.zeros(len(a), np.uint32) for a in asked]
        n_words = n_tokens = 0
        start = W.mix64(np.array([_START]))[0]  # a context, never a word
        for i in range(parts):
            pieces = [a[c[i]:c[i + 1]] for a, c in zip(asked, cuts, strict=True)]
            grams, index = np.unique(np.concatenate(pieces), return_inverse=True)
            total = np.bincount(index, weights=np.concatenate([s[c[i]:c[i + 1]] for s, c in zip(seen, cuts, strict=True)]), minlength=len(grams)).astype(np.uint32)
            if k == 1:
                words = total[grams != start]
                n_words, n_tokens = n_words + int((words > 0).sum()), n_tokens + int(words.sum(dtype=np.int64))
            at = 0
            for c, out in zip(cuts, counts, strict=True):
                n = c[i + 1] - c[i]
                out[c[i]:c[i + 1]] = total[index[at:at + n]]
                at += n
        for i, (block, c) in enumerate(zip(part.column("block").to_pylist(), counts, strict=True)):
            rows["bucket"].append(bucket)
            rows["block"].append(block)
            rows["level"].append(int(k))
            rows["counts"].append(_planes(c))
            rows["n_words"].append(n_words if i == 0 else 0)
            rows["n_tokens"].append(n_tokens if i == 0 else 0)
    return pa.table(rows, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("level", pa.int32()), ("counts", pa.binary()),
                                            ("n_words", pa.int64()), ("n_tokens", pa.int64())]))


class Automaton:
    """The part of the backoff automaton that the documents of a block can reach.

    States are contexts of 0 to ``order - 1`` symbols, numbered by length (state 0 is
    the root).  ``arc`` holds state and symbol of every arc in ascending order,
    ``weight`` its log10 probability and ``target`` the state it leads to; ``fail`` and
    ``fail_weight`` are a state's failure arc.  At the root every symbol has an arc.
    """

    def __init__(self, s: _Stream, counts: list[np.ndarray], order: int, strength: float, tokens: int, words: int):
        n, self.symbols = len(s.hash), int(s.symbol.max(initial=0)) + 1
        chance = (counts[0] + 0.5) / (tokens + 0.5 * (words + 1))
        # per position: the state (and the count) of the context of each length that ends there
        state = [np.zeros(n, np.int64)]
        seen_at = [np.zeros(n)]
        first, fails, weights = 1, [np.zeros(1, np.int64)], [np.zeros(1)]
        arcs, arc_weights, targets = [], [], []
        probability = np.zeros(n)
        for k in range(1, order + 1):
            grams, at, index = s.grams(k)
            c = np.zeros(n)
            c[at] = counts[k - 1][index]
            if k == 1:
                probability = chance[index]
                has = at
            else:
                before = at - 1
                probability = probability.copy()
                probability[at] = (c[at] + strength * probability[at]) / (seen_at[k - 1][before] + strength)
                has = at[c[at] > 0]
            arcs.append(state[k - 1][has - 1] * self.symbols + s.symbol[has] if k > 1 else s.symbol[has])
            arc_weights.append(np.log10(probability[has]))
            if k < order:
                own = np.full(n, -1, np.int64)
                own[at] = first + index
                spot = np.zeros(len(grams), np.int64)
                spot[index] = at
                fails.append(state[k - 1][spot])
                weights.append(np.log10(strength / (counts[k - 1] + strength)))
                state.append(np.where(own >= 0, own, state[k - 1]))
                seen_at.append(c)
                first += len(grams)
            # to the context that the symbol makes with its own: longer ones were never seen, and would fail at no cost
            targets.append(state[min(k, order - 1)][has])
        self.fail, self.fail_weight = np.concatenate(fails), np.concatenate(weights)
        every, where = np.unique(np.concatenate(arcs), return_index=True)
        self.arc, self.weight, self.target = every, np.concatenate(arc_weights)[where], np.concatenate(targets)[where]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log10 probabilities): failure arcs until there is an arc."""
        weight = np.zeros(len(state))
        key = state * self.symbols + symbol
        at = np.searchsorted(self.arc, key)
        at[at == len(self.arc)] = 0
        lost = np.flatnonzero(self.arc[at] != key)
        state = state.copy()
        while len(lost):
            weight[lost] += self.fail_weight[state[lost]]
            state[lost] = self.fail[state[lost]]
            key = state[lost] * self.symbols + symbol[lost]
            found = np.searchsorted(self.arc, key)
            found[found == len(self.arc)] = 0
            at[lost] = found
            lost = lost[self.arc[found] != key]
        return self.target[at], weight + self.weight[at]


_SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _read_block(path: str, block: int) -> dict:
    with open_in(path) as f:
        return parquet.read_table(f, filters=[("block", "=", block)]).to_pylist()[0]


def _traverse(order: int, strength: float, tokens: int, words: int):
    def traverse(block: pa.Table, answers: pa.Table) -> pa.Table:
        r = _read_block(block.column("file")[0].as_py(), block.column("block")[0].as_py())
        s = _Stream(r["ids"], r["words"], r["lengths"], r["train"])
        level, bucket = answers.column("level").to_numpy(), answers.column("bucket").to_numpy()
        counts = []
        for k in range(1, order + 1):
            rows = np.flatnonzero(level == k)
            counts.append(np.concatenate([_unplanes(answers.column("counts")[int(i)].as_py()) for i in rows[np.argsort(bucket[rows])]]).astype(np.float64))
        automaton = Automaton(s, counts, order, strength, tokens, words)
        # all documents of the block at once, from left to right; a document carries its state
        size = np.diff(s.first)
        n = len(size)
        unigram = (counts[0] + 0.5) / (tokens + 0.5 * (words + 1))
        grams, at, index = s.grams(1)
        real = s.place > 0  # the start is a state, not a token
        base = np.where(real, np.log10(unigram)[index], 0.0)
        known = np.where(real, counts[0][index] > 0, False)
        total = lambda x: np.add.reduceat(x, s.first[:-1]) if n else np.zeros(0)
        state, score = np.zeros(n, np.int64), np.zeros(n)
        order_by_size = np.argsort(-size, kind="stable")
        left = size[order_by_size]
        for step in range(int(size.max(initial=0))):
            live = order_by_size[:int(np.searchsorted(-left, -step))]
            state[live], weight = automaton.step(state[live], s.symbol[s.first[live] + step])
            if step:
                score[live] += weight
        return pa.table({"doc_id": pa.array(r["doc_ids"], pa.int64()), "train": pa.array(r["train"], pa.bool_()), "n_tokens": pa.array(total(real.astype(np.int64))),
                         "n_known": pa.array(total(known.astype(np.int64))), "base_score": pa.array(total(base), pa.float64()),
                         "score": pa.array(score, pa.float64())})
    return traverse


def score_texts(docs: DataFrame, train: Column, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text) under the model of the rows where ``train`` is true.

    Words are lower-cased (A-Z) runs between ASCII white space; every text ends
    with an end token, so an empty or null text has one token.  A null ``train``
    is false.  Returns doc_id, train, n_tokens, n_known, base_score, score and
    train_tokens; repeated rows are scored alike, each counts in training.
    Other columns are not read.  The steps between are written to the shared
    folder; two numbers (tokens and distinct words) reach the driver.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "lm")

    def kept(df: DataFrame, name: str, schema: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{path}-{name}")
        return spark.read.schema(schema).parquet(f"{path}-{name}")

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), "text")
    blocks = kept(rows.mapInArrow(_blocks, _BLOCKS), "blocks", _BLOCKS)
    asked = blocks.mapInArrow(_ask(order, buckets), _ASK).repartition(buckets, "bucket")
    answers = kept(asked.groupBy("bucket").applyInArrow(_answer, _ANSWER), "answers", _ANSWER)
    n = answers.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
    tokens, words = n.tokens or 0, n.words or 0
    parts = buckets // 4
    told = answers.select("bucket", "block", "level", "counts").repartition(parts, "block")
    # blocks stay in their files
    places = blocks.select("block", F.col("_metadata.file_path").alias("file")).repartition(parts, "block")
    scored = places.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _traverse(order, strength, tokens, words), _SCORES)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("bigint"))


def op2_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored; those whose crc32 of the id's text is 1 modulo 5 are held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    scored = score_texts(docs, fold != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
