"""Projections, filters, reshape and set operations."""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.operators.scan import keep_first
from pairlab.operators.texts import per_text, transform_texts


def clean_code_rows(df: DataFrame, code: str = "code") -> DataFrame:
    """Drop rows whose code is NULL or empty (whitespace-only code stays)."""
    return df.filter(F.col(code).isNotNull() & (F.length(F.col(code)) > 0))


def dropped_rows(df: DataFrame, code: str = "code") -> DataFrame:
    """P2 report: how many rows ``clean_code_rows`` removes."""
    return df.agg(F.count_if(F.col(code).isNull() | (F.length(F.col(code)) == 0)).alias("n_dropped"))


def _literal_list(x: str) -> list[str | None]:
    v = ast.literal_eval(x)
    if not isinstance(v, (list, tuple)):
        raise ValueError("not a list")
    return [None if e is None else str(e) for e in v]


def looks_like_list(c: Column) -> Column:
    return (F.length(c) > 1) & c.startswith("[") & c.endswith("]")


_LISTS = T.ArrayType(T.StringType())


def _list_literals(texts: pd.Series) -> pd.Series:
    """Lists of the texts that are Python literals, other texts NULL; equal texts of a batch are parsed once."""
    done: dict[str, list[str | None] | None] = {}
    for x in texts.dropna().unique():
        try:
            done[x] = _literal_list(x)
        except Exception:
            done[x] = None
    return pd.Series([done.get(x) for x in texts], dtype=object)


def _with_json(df: DataFrame, c: str) -> DataFrame:
    """``_json``: the lists of the texts that are JSON; ``_literal``: list-looking texts that are not."""
    text, listed = F.col(c), looks_like_list(F.col(c))
    d = df.withColumn("_json", F.when(listed, F.from_json(text, _LISTS, {"allowSingleQuotes": "true"})))
    return d.withColumn("_literal", F.when(listed & F.col("_json").isNull(), text))


def _parsed(c: str, literal: Column) -> Column:
    return (F.when(F.col(c).isNull(), F.lit(None)).when(~looks_like_list(F.col(c)), F.array(F.col(c)))
            .otherwise(F.coalesce(F.col("_json"), literal)))


def parse_list_literal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """List-looking strings -> array<string>; any other text is one answer.

    JSON (single quotes allowed) is parsed JVM-side; the texts it cannot parse
    (Python literal forms such as ``None``) go through ``ast.literal_eval`` in Arrow
    batches where they are, so no row is shuffled or written.  A list-looking text that
    neither can parse becomes NULL.
    """
    order, parse = df.columns, F.pandas_udf(_list_literals, _LISTS)
    for c in cols:
        df = _with_json(df, c).withColumn(c, _parsed(c, parse(F.col("_literal")))).select(*order)
    return df


def parse_list_job(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What ``parse_list_literal`` gives, and, per column, the report of the texts that were no
    JSON; for that they are a text job, each distinct text once."""
    order, reports = df.columns, {}
    for c in cols:
        job = transform_texts(_with_json(df, c), "_literal", per_text(_literal_list), out="_list", to=_LISTS)
        reports[c] = job.report()
        df = job.rows.withColumn(c, _parsed(c, F.col("_list"))).select(*order)
    return df, reports


def explode_generations(df: DataFrame, col: str = "generated_answers", *, keys: Sequence[str],
                        idx: str = "gen_idx", out: str = "code") -> DataFrame:
    """P5: ragged answer lists -> one row per (input, answer index)."""
    return df.select(*keys, F.posexplode_outer(col).alias(idx, out))


def unpivot_code(df: DataFrame, ids: Sequence[str], code_cols: Sequence[str]) -> DataFrame:
    """Wide code columns -> (ids..., code_type, code)."""
    return df.unpivot(list(ids), list(code_cols), "code_type", "code")


def pivot_results(df: DataFrame, *, key: str, types: Sequence[str], values: Sequence[str],
                  type_col: str = "code_type", order: str | None = None,
                  base_type: str | None = None, base_cols: Sequence[str] = (),
                  value_types: Sequence[str] | None = None) -> DataFrame:
    """Long results -> one row per key with ``{type}_{value}`` columns.

    Explicit pivot values (no discovery job); several rows of one type: the
    last by ``order`` wins.  ``base_type`` / ``base_cols``: columns copied from
    the first row of that type by ``order`` (e.g. the slow program's row).  ``value_types``
    limits which types get value columns (e.g. generations only unless the
    slow and reference programs were re-measured).
    """
    packed = F.struct(*[F.col(v) for v in values])
    agg = F.max_by(packed, F.col(order)) if order else F.first(packed, ignorenulls=True)
    wide = df.groupBy(key).pivot(type_col, list(types)).agg(agg)
    vt = list(types) if value_types is None else [t for t in types if t in value_types]
    out = wide.select(key, *[F.col(f"`{t}`")[v].alias(f"{t}_{v}") for t in vt for v in values])
    if base_type is not None and base_cols:
        base = keep_first(df.filter(F.col(type_col) == F.lit(base_type)), [key], [order or key])
        out = out.join(base.select(key, *base_cols), key, "left")
    return out


def select_report_columns(df: DataFrame, *, names: Sequence[str] = (), suffixes: Sequence[str] = (),
                          parts: Sequence[str] = ()) -> DataFrame:
    """Keep columns named exactly, by suffix, or containing a substring."""
    keep = [c for c in df.columns
            if c in names or any(c.endswith(s) for s in suffixes) or any(p in c for p in parts)]
    return df.select(*keep)


def rename_runtime_columns(df: DataFrame, *, mapping: dict[str, str], keep_old: bool = False) -> DataFrame:
    """Rename runtime columns (only those present); optionally keep the old ones."""
    present = {a: b for a, b in mapping.items() if a in df.columns}
    if keep_old:
        return df.select("*", *[F.col(a).alias(b) for a, b in present.items()])
    return df.withColumnsRenamed(present)


def split_cached_rows(df: DataFrame, *, types: Sequence[str], type_col: str = "code_type"):
    """P10: (rows whose type is cached, rows still to process) - an exact split."""
    cached = F.col(type_col).isin(*types)
    return df.filter(cached), df.filter(~cached | F.col(type_col).isNull())


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by column name, missing columns as NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def array_set_algebra(a, b, op: str) -> Column:
    """Set intersection, difference or union of two id arrays (distinct)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return {"intersect": F.array_intersect, "except": F.array_except, "union": F.array_union}[op](a, b)


def partition_check(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """U4: rows that differ between a table and the union of its parts
    (as multisets); empty when the split lost or doubled nothing."""
    cols = whole.columns
    parts = parts.select(*cols)
    return (whole.exceptAll(parts).withColumn("side", F.lit("missing"))
            .unionByName(parts.exceptAll(whole).withColumn("side", F.lit("extra"))))


def order_work(df: DataFrame, *, length: str, tests: str, key: str | None = None) -> DataFrame:
    """Longest first (ties by ``key``), test ids of each row in descending order."""
    by = [F.col(length).desc(), *([F.col(key)] if key else [])]
    return df.withColumn(tests, F.sort_array(F.col(tests), asc=False)).orderBy(*by)


def merge_completions(inputs: DataFrame, completions: DataFrame, *, key: str = "src_id",
                      how: str = "left") -> DataFrame:
    """Completions joined back to their inputs on an explicit key."""
    return inputs.join(completions, key, how)
