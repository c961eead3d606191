"""Null / NaN / Infinity contract shared by every operator.

The source data treats a failed run as runtime +inf and uses pandas rules:
``x / inf = 0``, ``x / 0 = inf``, ``0 / 0 = NaN``, aggregates skip NaN and
``max(1.0, NaN) == 1.0``.  Spark (ANSI mode) differs on each point, so every
operator goes through these column helpers instead of raw arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def inf() -> Column:
    return F.lit(INF).cast("double")


def nan_to_null(c) -> Column:
    """NaN -> NULL, so that avg/max/stddev skip it like pandas does."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def is_finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INF)


def finite_or_null(c) -> Column:
    """Keep finite values, map NaN/+-inf to NULL (used for hashed sinks)."""
    c = col(c)
    return F.when(is_finite(c), c).otherwise(F.lit(None).cast("double"))


def safe_divide(num, den) -> Column:
    """num / den with pandas semantics; 0/0 (NaN) becomes NULL.

    Division by zero never reaches the ANSI divide because CASE branches are
    evaluated lazily.
    """
    n, d = col(num).cast("double"), col(den).cast("double")
    return (
        F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
        .when(d == 0, F.when(n > 0, inf()).when(n < 0, -inf()).otherwise(F.lit(None).cast("double")))
        .otherwise(nan_to_null(n / d))
    )


def floored(c, floor: float = 1.0) -> Column:
    """max(floor, x) where a missing or NaN x yields the floor (Python max)."""
    c = col(c)
    return F.when(c.isNull() | F.isnan(c), F.lit(floor)).otherwise(F.greatest(F.lit(floor), c))


def floored_speedup(old, new, floor: float = 1.0) -> Column:
    """max(floor, old / new)."""
    return floored(safe_divide(old, new), floor)


def reached(c, threshold: float) -> Column:
    """x >= t where missing/NaN counts as not reached (stays in denominators)."""
    return F.coalesce(nan_to_null(c) >= F.lit(threshold), F.lit(False))


def differs(a, b) -> Column:
    """a != b where a missing side counts as different."""
    return F.coalesce(col(a) != col(b), F.lit(True))


# Characters str.strip() removes, derived from Python's own str.isspace().
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def py_strip(c) -> Column:
    """str.strip(): remove leading/trailing whitespace (native btrim, no regex)."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def round6(c) -> Column:
    """Round half up to 6 places with plain IEEE arithmetic (floor(x*1e6+0.5)/1e6),
    so any engine computing the same double gets the same digits."""
    x = finite_or_null(c)
    return F.when(F.abs(x) < 1e12, F.floor(x * 1e6 + 0.5) / 1e6).otherwise(x)
