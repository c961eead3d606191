"""Registry of checked queries: a Spark plan and (when SQL can say it) an oracle.

Every query reads the driver's tables (or views Spark derives from them) in
full.  Outputs are normalised the same way on both sides: integers as BIGINT,
reals rounded to 6 places with NaN/inf mapped to NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.numeric import round6


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


REGISTRY: dict[str, Query] = {}


def normalise(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = round6(c.cast("double"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, oracle: str | None = None):
    if oracle and oracle.strip().startswith(","):  # CTE list without its WITH
        oracle = "WITH " + oracle.strip()[1:]

    def deco(fn):
        REGISTRY[name] = Query(name, lambda spark, sf_dir: normalise(fn(spark, sf_dir)), oracle)
        return fn
    return deco


# ---- oracle SQL snippets (DuckDB) ------------------------------------------

def fin(expr: str) -> str:
    """Round to 6 places; NaN/inf -> NULL; DOUBLE."""
    x = f"(CASE WHEN isfinite(CAST({expr} AS DOUBLE)) THEN CAST({expr} AS DOUBLE) END)"
    return f"CAST(CASE WHEN abs({x}) < 1e12 THEN floor({x} * 1e6 + 0.5) / 1e6 ELSE {x} END AS DOUBLE)"


def sdiv(n: str, d: str) -> str:
    """pandas-style division: x/0 = +-inf, 0/0 = NULL."""
    return (f"(CASE WHEN ({n}) IS NULL OR ({d}) IS NULL THEN NULL "
            f"WHEN ({d}) = 0 THEN CASE WHEN ({n}) > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN ({n}) < 0 THEN CAST('-inf' AS DOUBLE) END "
            f"ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END)")


def floor1(expr: str, floor: float = 1.0) -> str:
    return (f"(CASE WHEN ({expr}) IS NULL OR isnan({expr}) THEN CAST({floor} AS DOUBLE) "
            f"ELSE greatest(CAST({floor} AS DOUBLE), {expr}) END)")


INF_SQL = "CAST('inf' AS DOUBLE)"


def sql_str(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def template_sql(template: str, values: dict[str, str]) -> str:
    """SQL twin of ``fill_template``: literal pieces and slot expressions concatenated."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(sql_str(template[pos:m.start()]))
        parts.append(values[m.group(1)])
        pos = m.end()
    parts.append(sql_str(template[pos:]))
    return " || ".join(f"({x})" for x in parts)
