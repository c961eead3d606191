"""Row-level text work as one job over a whole table.

``transform_texts`` takes the distinct texts of a column, transforms each once in
Arrow batches, writes the results and joins them back by hash.  A text that a third
of all rows carry is shipped once per map task (a partial aggregate) and transformed
once; joined back, its rows are split by AQE.  What the transformation changed or
could not do is counted from the written results, without another pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pairlab.functions.text import block_text, cut_after_main
from pairlab.session import materialize

#: a text transformation: a batch of texts to as many results
Batch = Callable[[list[str]], Sequence[Any]]
#: texts (and bytes of texts) given to a transformation at once
BATCH_TEXTS, BATCH_CHARS = 1024, 1 << 20


@dataclass
class Transformed:
    """``rows``: the input with the results; ``texts``: one row per distinct text (text_hash, n_rows, result, changed, failed)."""
    rows: DataFrame
    texts: DataFrame

    def report(self) -> DataFrame:
        """One row: rows, null rows, distinct texts, and rows and texts that were changed or failed."""
        text, n = F.col("text_hash").isNotNull(), F.col("n_rows")
        total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("bigint")
        return self.texts.agg(total(F.lit(True)).alias("n_rows"), total(~text).alias("n_null_rows"), F.count_if(text).alias("n_texts"),
                              total(F.col("changed")).alias("n_changed_rows"), F.count_if(F.col("changed")).alias("n_changed_texts"),
                              total(F.col("failed")).alias("n_failed_rows"), F.count_if(F.col("failed")).alias("n_failed_texts"))


def _pieces(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch: at most ``BATCH_TEXTS``, of about ``BATCH_CHARS`` bytes of text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
    lo = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= BATCH_CHARS or i + 1 - lo >= BATCH_TEXTS:
            yield b.slice(lo, i + 1 - lo)
            lo, size = i + 1, 0
    if lo < b.num_rows:
        yield b.slice(lo)


def _apply(fn: Batch, texts: list[str]) -> tuple[list, list[bool]]:
    """Results and failures: if a batch raises, its texts are tried one by one."""
    try:
        out = list(fn(texts))
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} results for {len(texts)} texts")
        return out, [False] * len(texts)
    except Exception:
        if len(texts) == 1:
            return [None], [True]
    parts = [_apply(fn, [t]) for t in texts]
    return [x for out, _ in parts for x in out], [x for _, bad in parts for x in bad]


def per_text(fn: Callable[[str], Any]) -> Batch:
    """A transformation of single texts as one of batches."""
    return lambda texts: [fn(t) for t in texts]


def transform_texts(df: DataFrame, col: str, fn: Batch, *, out: str | None = None, to: T.DataType | None = None) -> Transformed:
    """Column ``col`` transformed by ``fn`` into ``out`` (default: in place) of type ``to`` (default: string).

    ``fn`` gets lists of distinct non-null texts and gives as many results; a text
    for which it raises has the result NULL and counts as failed.  A NULL text stays
    NULL.  A string result counts as changed if it differs from the text, any other
    never.  Texts are told apart by SHA-256.
    """
    to = to or T.StringType()
    out = out or col
    hashed = df.withColumn("__text_hash", F.sha2(F.col(col), 256))
    texts = hashed.groupBy("__text_hash").agg(F.first(col).alias("__text"), F.count(F.lit(1)).alias("n_rows"))
    arrow = to_arrow_type(to)
    schema = T.StructType([T.StructField("text_hash", T.StringType()), T.StructField("n_rows", T.LongType()), T.StructField("result", to),
                           T.StructField("changed", T.BooleanType()), T.StructField("failed", T.BooleanType())])
    as_is = isinstance(to, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker holds one piece's texts and results, not a batch's (a text's ids are many times its size)
        for b in (piece for batch in batches for piece in _pieces(batch, 1)):
            given = b.column(1).to_pylist()
            results, failed = _apply(fn, [t for t in given if t is not None])
            results, failed = iter(results), iter(failed)
            rows = [(None, False) if t is None else (next(results), next(failed)) for t in given]
            changed = [as_is and not f and t is not None and r != t for t, (r, f) in zip(given, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r for r, _ in rows], arrow), pa.array(changed, pa.bool_()),
                                              pa.array([f for _, f in rows], pa.bool_())], names=schema.fieldNames())

    done = materialize(texts.mapInArrow(run, schema), "texts")
    results = done.where("text_hash IS NOT NULL").select(F.col("text_hash").alias("__text_hash"), F.col("result").alias("__result"))
    kept = hashed.drop(col) if out == col else hashed
    joined = kept.join(results, "__text_hash", "left").withColumnRenamed("__result", out).drop("__text_hash")
    order = df.columns if out in df.columns else [*df.columns, out]
    return Transformed(joined.select(*order), done)


def encode_ids(df: DataFrame, col: str, tokenizer, *, out: str) -> Transformed:
    """Token ids (array of int) of a text column; ``tokenizer`` has ``encode`` (batches) or is a callable of one text."""
    encode = getattr(tokenizer, "encode", None) or per_text(tokenizer)
    return transform_texts(df, col, lambda texts: [[int(i) for i in ids] for ids in encode(texts)], out=out, to=T.ArrayType(T.IntegerType()))


def decode_ids(df: DataFrame, col: str, tokenizer, *, out: str = "text") -> DataFrame:
    """Texts of token ids by ``tokenizer.decode``, in Arrow batches (NULL: NULL)."""
    schema = T.StructType([*df.drop(out).schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index(col)).to_pylist()
            decoded = iter(tokenizer.decode([x for x in ids if x is not None]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else next(decoded) for x in ids], pa.string())], names=schema.fieldNames())

    return df.drop(out).mapInArrow(run, schema)


def count_tokens(df: DataFrame, col: str, tokenizer, *, out: str = "n_tokens") -> Transformed:
    """F3 by a tokenizer: tokens of each text (NULL: 0), by its ``count`` if it has one."""
    encode = getattr(tokenizer, "encode", None) or per_text(tokenizer)
    count = getattr(tokenizer, "count", None) or (lambda texts: [len(ids) for ids in encode(texts)])
    done = transform_texts(df, col, count, out=out, to=T.LongType())
    return Transformed(done.rows.withColumn(out, F.when(F.col(col).isNull(), F.lit(0)).otherwise(F.col(out))), done.texts)


def pages_to_text(df: DataFrame, col: str = "html", *, out: str | None = None, fallback: int = 25) -> Transformed:
    """F2 as a job: the block-aware text of every page."""
    return transform_texts(df, col, per_text(partial(block_text, fallback=fallback)), out=out)


def first_programs(df: DataFrame, col: str = "code", *, out: str | None = None) -> Transformed:
    """F9 as a job: every completion up to the end of its first ``main``."""
    return transform_texts(df, col, per_text(cut_after_main), out=out)
