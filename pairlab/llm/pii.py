"""Personal data: fixed patterns, then bootstrapped contextual extraction.

The fixed patterns (email, ip, card, phone) give base spans.  They are the seeds:
the words around a seed are lexical patterns (the two words before; the word
before and the word after), and other strings of an identifier's shape in the
same contexts are its candidates.  Patterns and instances form a bipartite
graph per kind.  Rounds on Spark score a pattern by the share of trusted
instances among all it extracts, and an untrusted instance by the noisy-or of
its good patterns; an instance over the threshold is trusted from then on and
supports further patterns.  Only distinct (instance, pattern) edges count, so
copies of a document add no evidence and a hot context is a partial aggregate.

Texts are scanned once, where they lie; only mentions travel.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm import words as W
from pairlab.llm.base import table, written

KINDS = ("email", "ip", "card", "phone")
#: trusted instances that a pattern needs, its least precision, an instance's least score
SUPPORT, PRECISION, SCORE = 3, 0.6, 0.65

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = np.zeros(256, dtype=bool)
_LOCAL[list(b"._%+-")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _LOCAL[_a:_b] = True
_EDGE = b"\"'`()[]{}<>=,.;:!?|*#$%&"
_NUMERIC = re.compile(rb"[0-9()+.\-]*[0-9][0-9()+.\-]*")
_CANDIDATE_IP = re.compile(rb"[0-9]+(?:\.[0-9]+){3,}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}")
_CANDIDATE_EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9._-]+")


def _digits(b: bytes) -> bytes:
    return bytes(c for c in b if 48 <= c < 58)


def luhn(number: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: int, found: bytes) -> bool:
    if kind == 1:
        return all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip(b"0") or b"0" for p in found.split(b".")))
    if kind == 2:
        d = _digits(found)
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == 0 or 8 <= len(_digits(found)) <= 15


def _base(data: bytes, lo: int, hi: int, ats: np.ndarray, pluses: np.ndarray, runs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) in the text ``data[lo:hi]``; a match that fails its check still uses up its characters."""
    last = lo
    for p in ats.tolist():
        s = p
        while s > last and _LOCAL[data[s - 1]]:
            s -= 1
        m = _DOMAIN.match(data, p + 1, hi) if s < p and p >= last else None
        if m:
            yield 0, s, m.end()
            last = m.end()
    for kind, pattern, starts in ((1, _IP, runs), (2, _CARD, runs), (3, _PHONE, pluses)):
        last = lo
        for p in starts.tolist():
            m = pattern.match(data, p, hi) if p >= last else None
            if m:
                last = m.end()
                if _valid(kind, m[0]):
                    yield kind, p, last


def _shapes(token: bytes) -> tuple[int, ...]:
    """The kinds whose shape a string has (without meeting the kinds' own checks).

    13 to 15 digits may be a card or a phone; the patterns of each kind decide.
    """
    if b"@" in token:
        return (0,) if _CANDIDATE_EMAIL.fullmatch(token) else ()
    if _CANDIDATE_IP.fullmatch(token):
        return (1,)
    d = _digits(token)
    if not _NUMERIC.fullmatch(token.replace(b" ", b"")):
        return ()
    card = 13 <= len(d) <= 19 and not set(token) & set(b"()+.")
    return (2,) * card + (3,) * (7 <= len(d) <= 15)


def _candidates(data: bytes, words: list[tuple[int, int]], marked: list[int], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Identifier-shaped strings outside the base spans: words with a digit or @, numeric neighbours joined."""
    done = -1
    for i in marked:
        if i <= done:
            continue
        j = i
        if _NUMERIC.fullmatch(data[words[i][0]:words[i][1]]):
            while j + 1 < len(words) and words[j + 1][0] == words[j][1] + 1 and words[j + 1][1] - words[i][0] <= 32 and _NUMERIC.fullmatch(data[slice(*words[j + 1])]):
                j += 1
        done = j
        s, e = words[i][0], words[j][1]
        token = data[s:e]
        if len(token) > 128:
            continue
        s += len(token) - len(token.lstrip(_EDGE.replace(b"(", b"") if token[:1] == b"(" and b")" in token else _EDGE))
        e -= len(token) - len(token.rstrip(_EDGE))
        if not any(s < b and a < e for a, b in taken):
            for kind in _shapes(data[s:e]):
                yield kind, s, e


def _key(*parts: bytes | int) -> int:
    text = b"\0".join(str(p).encode() if isinstance(p, int) else p for p in parts)
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _word(data: bytes, span: tuple[int, int]) -> bytes:
    """A context word: lower-cased, without edge punctuation, digits masked."""
    return re.sub(rb"[0-9]+", b"0", data[span[0]:span[1]].lower().strip(_EDGE))


def _instance(kind: int, found: bytes) -> bytes:
    return found.lower() if kind < 2 else _digits(found)


def mentions_of(texts: pa.Array) -> list[list[dict]]:
    """Per text its mentions: kind, start, end (code points), seed, instance and pattern keys."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    whole, offsets = W.utf8(texts)
    for lo, d, o in W.chunks(whole, offsets):
        digit = _DIGIT[d]
        before = np.zeros(len(d), dtype=bool)
        before[1:] = digit[:-1]
        before[o[:-1][o[:-1] < len(d)]] = False
        runs, ats, pluses = np.flatnonzero(digit & ~before), np.flatnonzero(d == 64), np.flatnonzero(d == 43)
        if not len(runs) and not len(ats):
            continue
        start, end, first = W.spans(d, o)
        data = d.tobytes()
        points = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
        texts_here = np.unique(np.searchsorted(o, np.concatenate([runs, ats]), side="right") - 1)
        cut = [(np.searchsorted(x, o[texts_here]), np.searchsorted(x, o[texts_here + 1])) for x in (ats, pluses, runs)]
        for n, t in enumerate(texts_here.tolist()):
            a, p, r = (x[lo_[n]:hi_[n]] for x, (lo_, hi_) in zip((ats, pluses, runs), cut, strict=True))
            found = list(_base(data, int(o[t]), int(o[t + 1]), a, p, r))
            taken = sorted((s, e) for _, s, e in found)
            ws, we = start[first[t]:first[t + 1]], end[first[t]:first[t + 1]]
            marked = np.unique(np.searchsorted(ws, np.concatenate([r, a]), side="right") - 1)
            # only the words around the marked ones are needed
            near = np.unique(np.clip((marked[:, None] + np.arange(-3, 9)[None, :]).reshape(-1), 0, len(ws) - 1))
            words = list(zip(ws[near].tolist(), we[near].tolist(), strict=True))
            every = [(k, s, e, True) for k, s, e in found]
            free = [x for x in np.searchsorted(near, marked).tolist()]
            every += [(k, s, e, False) for k, s, e in _candidates(data, words, free, taken)]
            for kind, s, e, seed in every:
                i, j = int(np.searchsorted(we, s, side="right")), int(np.searchsorted(ws, e, side="left"))
                at = lambda x: _word(data, (int(ws[x]), int(we[x]))) if 0 <= x < len(ws) else b"^"  # noqa: B023, E731
                two, one, after = at(i - 2), at(i - 1), at(j)
                keys = [_key(kind, b"L", two, one)] if any(re.search(rb"[a-z\x80-\xff]", w) for w in (two, one)) else []
                keys += [_key(kind, b"R", one, after)] if re.search(rb"[a-z\x80-\xff]", one) and after != b"^" else []
                zero = int(points[o[t]])
                out[lo + t].append({"kind": kind, "start": int(points[s]) - zero, "end": int(points[e]) - zero, "seed": seed,
                                    "instance": _key(kind, _instance(kind, data[s:e])), "patterns": keys})
    return out


_MENTION = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("seed", T.BooleanType()), T.StructField("instance", T.LongType()), T.StructField("patterns", T.ArrayType(T.LongType()))])
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


@F.arrow_udf(T.ArrayType(_MENTION))
def _mentions(texts: pa.Array) -> pa.Array:
    return pa.array(mentions_of(texts), _ARROW)


def bootstrap(mentions: DataFrame, support: int = SUPPORT, precision: float = PRECISION, score: float = SCORE) -> DataFrame:
    """Trusted (instance, score, seed) from mention rows (seed, instance, patterns).

    A pattern's precision is trusted / (all + 1) over its distinct instances.
    ``seed`` marks the seeds, whose score is 1; the noisy-or of a found instance
    with many good patterns rounds to 1 as well.  Ends with a round that finds nothing.
    """
    edges = written(mentions.select("instance", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    trusted = written(mentions.where("seed").select("instance", F.lit(1.0).alias("score"), F.lit(True).alias("seed")).distinct(), "pii-trusted")
    while True:
        known = edges.join(trusted.select("instance", "score"), "instance", "left")
        patterns = known.groupBy("pattern").agg(F.count("score").alias("trusted"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("mass"))
        patterns = patterns.select("pattern", "trusted", (F.col("mass") / (F.col("n") + 1)).alias("precision")).where(
            (F.col("trusted") >= support) & (F.col("precision") >= precision))
        new = (known.where("score IS NULL").select("instance", "pattern").join(patterns, "pattern").groupBy("instance")
               .agg((1 - F.exp(F.sum(F.log(1 - F.col("precision"))))).alias("score")).where(F.col("score") >= score))
        new = written(new.withColumn("seed", F.lit(False)), "pii-new")
        if new.isEmpty():
            return trusted
        trusted = written(trusted.union(new), "pii-trusted")


def extract_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and ``spans``, an array of (kind, start, end, seed, score).

    ``kind`` indexes KINDS, offsets are code points (end exclusive), ``seed``
    marks the base spans; spans are sorted by kind and start.  A mention outside
    the base spans of an instance that is a seed elsewhere (a phone without its
    ``+``) is a span with score 1 and without the mark.  Null and empty texts
    have none.  Repeated rows have rows each but count as one as evidence.
    Other columns are not read.
    """
    rows = docs.select("doc_id", _mentions(F.col("text")).alias("mentions")).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "pii-mentions")
    each = rows.select("row", F.inline("mentions"))
    found = bootstrap(each.select("seed", "instance", "patterns")).select("instance", "score")
    added = (each.where("NOT seed").join(found, "instance").groupBy("row")
             .agg(F.collect_list(F.struct("kind", "start", "end", "seed", "score")).alias("added")))  # at most a document's own mentions
    base = F.transform(F.filter("mentions", lambda m: m.seed), lambda m: F.struct(m.kind.alias("kind"), m.start.alias("start"), m.end.alias("end"), m.seed.alias("seed"), F.lit(1.0).alias("score")))
    both = F.concat(base, F.coalesce(F.col("added"), F.array().cast("array<struct<kind:int,start:bigint,end:bigint,seed:boolean,score:double>>")))
    return rows.join(added, "row", "left").select("doc_id", F.array_sort(both).alias("spans"))


def spans_text(spans: F.Column) -> F.Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(kinds, s.kind), F.lit(":"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",")


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    found = extract_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.seed)
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.withColumn("base", base).select("doc_id", *counts, F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
