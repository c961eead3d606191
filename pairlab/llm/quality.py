"""Quality rules as a bitmask ledger.

Every text is measured once (vectorised over Arrow batches), every rule is
evaluated once on the measurements, and the ledger keeps both: measurements and
a bit per failed rule.  A policy is a named mask over the bits, so changing it,
comparing versions or asking what one rule costs needs no text: it is bitwise
arithmetic over the ledger, aggregated to at most ``2**rules`` distinct masks.

Nothing is shuffled to measure; a task holds one chunk of texts at a time.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm import words as W
from pairlab.llm.base import table

#: words of the windows whose repetition counts
WINDOW = 5
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_twin_words")

#: rules in bit order; a rule's condition (SQL over the measures) names the texts that fail it
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "capitals": "n_upper + n_lower >= 20 AND 100 * n_upper > 50 * (n_upper + n_lower)",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines",
    "twin_words": "100 * n_twin_words > 30 * n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 24 * n_words)",
}

#: versioned policies: the rules that reject
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "capitals", "repeated_lines", "twin_words", "word_length"),
}
PRODUCTION = "v1"


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _within(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes made distinct between texts."""
    return W.mix64(h ^ W.mix64(text.astype(np.uint64) + np.uint64(1)))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text (null: empty), as arrays of longs."""
    n = len(texts)
    out = {m: np.zeros(n, dtype=np.int64) for m in MEASURES}
    for w in W.scan(texts, lower=False):
        k = len(w.first) - 1
        at = slice(w.lo, w.lo + k)
        inside = ~W.SPACE[w.data]
        out["n_words"][at] = w.count
        out["word_chars"][at] = _per_text(inside & ((w.data & 0xC0) != 0x80), w.offsets)
        out["n_symbols"][at] = _per_text(SYMBOLS[w.data], w.offsets)
        out["n_upper"][at] = _per_text(_UPPER[w.data], w.offsets)
        out["n_lower"][at] = _per_text(_LOWER[w.data], w.offsets)
        # lines with a word: equal ones beyond the first count
        start, end, first = W.spans(w.data, w.offsets, _NEWLINE)
        total = np.zeros(len(w.data) + 1, dtype=np.int64)
        np.cumsum(inside, out=total[1:])
        full = total[end] > total[start]
        line_text = np.repeat(np.arange(k), np.diff(first))[full]
        keys = _within(W.hash_spans(w.data, start[full], end[full], lower=False), line_text)
        lines = np.bincount(line_text, minlength=k)
        distinct = np.bincount(line_text[np.unique(keys, return_index=True)[1]], minlength=k)
        out["n_lines"][at], out["n_dup_lines"][at] = lines, lines - distinct
        # words inside windows that occur twice or more in the text
        windows = W.window_hash(w.hash, WINDOW)
        owner = w.text_of()
        twin = np.zeros(len(owner), dtype=bool)
        twin[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
        out["n_twin_words"][at] = _per_text(twin, w.first)
        if len(windows):
            same = owner[:len(windows)] == owner[WINDOW - 1:]
            pos = np.flatnonzero(same)
            pos = pos[_repeated(_within(windows[pos], owner[pos]))]
            edge = np.zeros(len(owner) + 1, dtype=np.int64)
            np.add.at(edge, pos, 1)
            np.add.at(edge, pos + WINDOW, -1)
            out["n_repeat_words"][at] = _per_text(np.cumsum(edge[:-1]) > 0, w.first)
    return out


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measured(texts: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c) for c in measure(texts).values()], names=list(MEASURES))


def quality_ledger(docs: DataFrame, text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """``docs`` with the measures and ``fails`` (bit i is set when rule i fails).

    Null and empty texts have zero measures (and fail few_words).  Rows are
    judged one by one, so repeated rows are alike.  Columns of ``docs`` with the
    names of measures, or ``fails``, are replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (*MEASURES, "fails", "__m")]
    measured = docs.select(*kept, _measured(F.col(f"`{text}`")).alias("__m")).select(*kept, "__m.*")
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, condition in enumerate(rules.values())]
    fails = bits[0]
    for b in bits[1:]:
        fails = fails.bitwiseOR(b)
    return measured.withColumn("fails", fails.cast("bigint"))


def policy_mask(version: str, rules: Mapping[str, str] = RULES, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> int:
    names = list(rules)
    return sum(1 << names.index(r) for r in policies[version])


def passes(version: str = PRODUCTION, fails: str = "fails") -> Column:
    """True for the rows of a ledger that a policy keeps."""
    return F.col(fails).bitwiseAND(F.lit(policy_mask(version)).cast("bigint")) == 0


def apply_policy(ledger: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """The rows of a ledger that a policy keeps."""
    return ledger.where(passes(version))


def ablations(ledger: DataFrame, version: str = PRODUCTION, rules: Mapping[str, str] = RULES) -> DataFrame:
    """Per rule of a policy: rows that fail it, that only it rejects, and that the policy rejects and keeps.

    The ledger is counted by mask first (a partial aggregate of at most
    ``2**rules`` rows); everything else is bitwise arithmetic on those.  An
    empty ledger gives zeros.
    """
    mask = policy_mask(version, rules)
    masks = ledger.groupBy(F.col("fails").bitwiseAND(F.lit(mask).cast("bigint")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    names = list(rules)
    active = [r for r in names if mask >> names.index(r) & 1]
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    cells = []
    for r in active:
        bit = F.lit(1 << names.index(r)).cast("bigint")
        cells.append(F.struct(F.lit(r).alias("rule"), count(F.col("m").bitwiseAND(bit) != 0).alias("n_fail"), count(F.col("m") == bit).alias("n_only"),
                              count(F.col("m") != 0).alias("n_rejected"), count(F.col("m") == 0).alias("n_kept")))
    return masks.agg(F.array(*cells).alias("a")).select(F.inline("a"))


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, the base verdict and the production policy's for every whole text of ``documents``."""
    ledger = quality_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = ~passes("base")
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fails",
                         failed.alias("base_failed"), (~failed & passes()).alias("kept"))
