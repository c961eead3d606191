"""Spelling variants of a corpus' words, found through a reduced alphabet.

Every letter is mapped to one of ``SYMBOLS`` symbols.  Words one edit apart have
reduced words at most one edit apart, so a word's variants are among the words
whose reduced word lies in the full one-edit neighbourhood (itself, every
deletion, replacement and insertion) of its own.  With few symbols that
neighbourhood is small, whatever the size of the real alphabet.  It is joined
with the reduced vocabulary, and every candidate is verified on the original
strings.

A reduced word is known by a 64-bit polynomial of its symbols, so each neighbour
costs one multiplication, however long the word.  Before the join, neighbours that
no reduced word can equal are left out by a filter of a fixed ``FILTER_BITS`` bits
over the reduced vocabulary (a filter that has become full only lets more through).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import words as W
from pairlab.llm.base import table, written
from pairlab.llm.sql import crc32_sql

#: symbols of the reduced alphabet
SYMBOLS = 8
#: bits of the filter over reduced words (16 MB, at every size of the vocabulary)
FILTER_BITS = 27
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: words whose neighbourhoods are made at once
WORDS_AT_ONCE = 4096

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``[A-Za-z\\u00C0-\\u00FF]`` in UTF-8 texts: starts, ends, lengths in code points, first run per text.

    In UTF-8 the letters beyond ASCII are the byte C3 and one byte after it.
    """
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    start, end, first = W.runs(inside, offsets)
    leads = np.concatenate([[0], np.cumsum(lead)])
    return start, end, end - start - (leads[end] - leads[start]), first


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each byte span; ``before`` is that of what precedes it."""
    size = end - start
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-size, kind="stable")
    size, at, s = size[order], start[order], state[order]
    long = int(np.searchsorted(-size, -64))  # spans over 64 bytes, one by one
    for i in range(long):
        s[i] = zlib.crc32(data[at[i]:at[i] + size[i]].tobytes(), int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for step in range(int(size[long]) if long < len(size) else 0):
        n = int(np.searchsorted(-size, -step))
        part = s[long:n]
        s[long:n] = _CRC[(part ^ data[at[long:n] + step]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(s)
    out[order] = s ^ np.uint32(0xFFFFFFFF)
    return out


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow string array."""
    size = end - start
    upto = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(flat.tobytes()))


def _delete(data: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> list[str]:
    texts = strings(data, start, end).to_pylist()
    return [t[:p] + t[p + 1:] for t, p in zip(texts, place.tolist(), strict=True)]


def _count(min_length: int, noise: int):
    schema = pa.schema([("word", pa.large_string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in b.column(0).to_pylist()], np.uint32)
            data, offsets = W.utf8(b.column(1))
            for lo, d, o in W.chunks(data, offsets, 4 << 20):
                d = W.LOWER[d]
                start, end, length, first = letter_runs(d, o)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                long = length >= min_length
                start, end, length, text = start[long], end[long], length[long], text[long]
                h = crc32_spans(d, start, end, prefix[lo + text])
                hit = (h % noise == 0) if noise else np.zeros(len(h), dtype=bool)
                keys, where, n = np.unique(W.hash_spans(d, start[~hit], end[~hit], False), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([strings(d, start[~hit][where], end[~hit][where]), pa.array(n, pa.int64())], schema=schema)
                cut = _delete(d, start[hit], end[hit], (h[hit] % length[hit]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.large_string()), pa.array(np.ones(len(cut), np.int64))], schema=schema)
    return count


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = 31) -> DataFrame:
    """Distinct words of ``docs`` (doc_id, text) and how often they occur in all texts: word, n.

    Words are maximal runs of letters up to U+00FF with A-Z lower-cased; where
    ``noise`` divides the CRC-32 ``h`` of ``doc_id:run``, the run loses its code
    point ``h`` modulo its length (0: no run does).  Words of fewer than
    ``min_length`` code points or ``min_count`` occurrences are no words.  A null
    text has none; a null doc_id counts as an empty string; repeated rows count
    again.  Words are counted in the task before they are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = rows.mapInArrow(_count(min_length, noise), "word string, n long")
    return counted.where(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def symbols_of(points: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol (1 to ``symbols``) of each code point."""
    return (W.mix64(points.astype(np.uint64) + np.uint64(0x5EED)) % np.uint64(symbols)) + np.uint64(1)


class Reduced:
    """The reduced words of a batch, as polynomials that one edit changes in one step."""

    def __init__(self, words: list[str], symbols: int):
        self.symbols = symbols
        size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.value = symbols_of(points, symbols)
        self.size = size
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.word = np.repeat(np.arange(len(words)), size)
        self.place = np.arange(len(points)) - self.first[self.word]
        self.power, self.inverse = W._powers(int(size.max(initial=0)) + 2)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value * self.power[self.place], dtype=np.uint64)])
        self.before = total[:-1] - total[self.first[self.word]]
        self.whole = total[self.first[1:]] - total[self.first[:-1]]

    def codes(self) -> np.ndarray:
        return self._code(self.whole, self.size)

    @staticmethod
    def _code(value: np.ndarray, size: np.ndarray) -> np.ndarray:
        return W.mix64(value ^ W.mix64(size.astype(np.uint64)))

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, code) of the full one-edit neighbourhoods, one kind of edit at a time."""
        every = np.arange(len(self.size))
        yield every, self.codes()
        whole, size = self.whole[self.word], self.size[self.word]
        here = self.power[self.place]
        after = whole - self.before - self.value * here
        base, back = self.power[1], self.inverse[1]
        yield self.word, self._code(self.before + after * back, size - 1)
        for s in range(1, self.symbols + 1):
            other = self.value != s
            yield self.word[other], self._code((self.before + after + np.uint64(s) * here)[other], size[other])
            yield self.word, self._code(self.before + np.uint64(s) * here + (whole - self.before) * base, size + 1)
            yield every, self._code(self.whole + np.uint64(s) * self.power[self.size], self.size + 1)


def _batches(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, WORDS_AT_ONCE):
        yield b.slice(at, WORDS_AT_ONCE)


def _codes(symbols: int):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _batches(b):
                code = Reduced(part.column(0).to_pylist(), symbols).codes()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(code.view(np.int64))], names=["word", "n", "code"])
    return codes


def _filter(coded: DataFrame, bits: int) -> np.ndarray:
    """The filter over the codes: a bit array of ``2 ** bits`` bits, as 64-bit words.

    Tasks and then Spark combine bits by OR; at most ``2 ** (bits - 6)`` numbers reach the driver.
    """
    parts = coded.selectExpr(f"shiftrightunsigned(code, {70 - bits}) AS at", f"shiftleft(1L, CAST(shiftrightunsigned(code, {64 - bits}) & 63 AS INT)) AS bit")
    t = parts.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[t.column("at").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
    return out


def _neighbours(symbols: int, bits: int, filter_words):
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = filter_words.value
        for b in batches:
            for part in _batches(b):
                word, code = [], []
                for w, c in Reduced(part.column(0).to_pylist(), symbols).neighbours():
                    slot = c >> np.uint64(64 - bits)
                    found = (seen[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
                    word.append(w[found])
                    code.append(c[found])
                w, c = np.concatenate(word), np.concatenate(code)
                order = np.lexsort((c, w))
                w, c = w[order], c[order]
                new = np.ones(len(w), dtype=bool)
                new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(w[new])), pa.array(c[new].view(np.int64))], names=["word", "code"])
    return neighbours


def near_words(vocab: DataFrame, symbols: int = SYMBOLS, bits: int = FILTER_BITS) -> DataFrame:
    """All pairs of words that differ by one inserted, deleted or replaced code point, in both directions: word, near, near_n.

    ``vocab`` (word, n) has distinct words; a null word has no neighbours.
    """
    spark = vocab.sparkSession
    coded = written(vocab.where("word is not null").select("word", F.col("n").cast("bigint").alias("n"))
                    .mapInArrow(_codes(symbols), "word string, n long, code long"), "reduced-words")
    seen = spark.sparkContext.broadcast(_filter(coded, bits))
    probes = coded.select("word").mapInArrow(_neighbours(symbols, bits, seen), "word string, code long")
    others = coded.select("code", F.col("word").alias("near"), F.col("n").alias("near_n"))
    one_edit = (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)
    return probes.join(others.hint("merge"), "code").where(one_edit).select("word", "near", "near_n")


def _roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) by doubling: each round follows twice as many forms."""
    roots = written(forms.select("word", F.col("form").alias("root")), "forms")
    for k in range(max(0, math.ceil(math.log2(max(longest, 1))))):
        then = roots.select(F.col("word").alias("root"), F.col("root").alias("__on"))
        roots = written(roots.join(then, "root", "left").select("word", F.coalesce("__on", "root").alias("root")), f"roots-{k}")
    return roots


def spelling_groups(vocab: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """Per word of ``vocab`` (word, n): its form, root, n, n_near and form_n.

    A word's form is its near word of the largest n (ties: the smallest in
    code-point order), if that n is at least ``ratio`` times the word's own,
    else null; the root is the last form of the chain, the word itself if it
    has none.  An empty vocabulary gives no rows; rows with a null word are
    left out; words must be distinct.  One number reaches the driver.
    """
    words = written(vocab.where("word is not null").select("word", F.col("n").cast("bigint").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("form")))
    found = written(near_words(words, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near-words")
    joined = words.join(found, "word", "left")
    common = -F.col("best.neg") >= ratio * F.col("n")
    grouped = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(common, F.col("best.form")).alias("form"),
                                    F.when(common, -F.col("best.neg")).alias("form_n")), "spelling")
    # each form is `ratio` times as frequent as its word, so chains are short
    n = grouped.agg(F.max("n").alias("top"), F.min("n").alias("low")).first()
    longest = math.floor(math.log(max(n.top or 1, 1) / max(n.low or 1, 1), ratio) + 1e-9) + 1
    roots = _roots(grouped.where("form is not null"), longest)
    return grouped.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling groups of the words of all whole ``documents`` texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_groups(written(vocabulary(docs), "vocabulary"))


ORACLE = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
, g AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL)
, h AS (SELECT run, n, {crc32_sql("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM g)
, w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
, v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT})
, p AS (SELECT word, substr(word, 1, i) || '*' || substr(word, i + 2) AS hole, substr(word, 1, i) || substr(word, i + 2) AS cut FROM v, unnest(range(length(word))) AS u(i))
, near AS (SELECT a.word, b.word AS near FROM p a JOIN p b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT p.word, v.word FROM p JOIN v ON v.word = p.cut UNION SELECT v.word, p.word FROM p JOIN v ON v.word = p.cut)
, best AS (SELECT near.word, near.near AS form, v.n AS form_n, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN v ON v.word = near.near
  QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near.near) = 1)
, f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n
  FROM v LEFT JOIN best USING (word))
, walk AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, step) AS root, any_value(n) AS n, CAST(any_value(n_near) AS BIGINT) AS n_near, any_value(form_n) AS form_n FROM f JOIN walk USING (word) GROUP BY f.word, form"""
