"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts gives every document its set size, a 128-bit digest
   of its shingle set, the keys of its bands and a signature of further hashes.
   Documents with equal sets fall into one class by digest (a partial
   aggregate, so a hot group of copies shrinks before the shuffle).
2. Classes that share a band key are candidates.  A bucket is not expanded into
   pairs: its members are compared with one centre, members that became
   connected need no further comparison, and the next round takes another
   centre.  Whatever is left after the star rounds is compared block against
   block inside tasks, which return only links that join what was apart.
3. A candidate pair compares its signatures batch by batch.  With ``m`` of ``n``
   hashes equal and a uniform prior the similarity is Beta(m+1, n-m+1); a pair
   is dropped once its chance to reach the threshold is below ``MISS``.
4. Survivors are verified on their full sets: members of a centre travel to it
   in salted groups of bounded size.  Verified links go into connected components.

Bands miss a pair at the threshold with probability
``(1 - T**ROWS)**BANDS`` (4e-7 at 0.85, 3e-5 at 0.8), the pruning with less than ``BATCHES * MISS``.
Small tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm import words as W
from pairlab.llm.base import table, written

SHINGLE = 5
#: link when 100 * intersection >= PERCENT * union, where a caller names no other threshold
PERCENT = 85
BANDS, ROWS = 20, 4
BATCH, BATCHES = 16, 6
HASHES = BATCH * BATCHES
MISS = 1e-8
#: star rounds before the rest is compared block against block; classes in a block
STARS, BLOCK = 2, 2048
#: shingles of a block's sets, which bound it as well
BLOCK_SHINGLES = 1 << 20
#: shingles that travel to one copy of a centre's set
GROUP_SHINGLES = 1 << 18

_SEEDS = W.mix64(np.arange(1, 2 * (BANDS * ROWS + HASHES) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def least_matches(threshold: float = PERCENT / 100, miss: float = MISS) -> list[int]:
    """Per batch the fewest equal hashes with which a pair goes on.

    P(J >= t | m of n equal) under a uniform prior is P(Bin(n + 1, t) <= m).
    """
    out = []
    for i in range(1, BATCHES + 1):
        n, total, m = BATCH * i, 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, text of each hash): distinct shingles, sorted within each text.

    A text of fewer words has its whole word sequence as its one shingle; one
    without words (or null) has none.
    """
    for w in W.scan(texts, lower=True):
        owner = w.text_of()
        h = W.window_hash(w.hash, SHINGLE)
        if len(h):
            whole = owner[:len(h)] == owner[SHINGLE - 1:]
            h, text = h[whole], owner[:len(h)][whole]
        else:
            text = owner[:0]
        short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
        if len(short):
            extra = [W.mix64(W.window_hash(w.hash[w.first[i]:w.first[i + 1]], int(w.count[i])) + w.count[i].astype(np.uint64)) for i in short]
            h, text = np.concatenate([h, *extra]), np.concatenate([text, short])
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        if len(h):
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            h, text = h[new], text[new]
        yield w.lo, h, text


def _digests(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set: its digest."""
    return np.stack([np.add.reduceat(W.mix64(h), starts), np.add.reduceat(W.mix64(h ^ _SEEDS[0]), starts)], axis=1)


def _sign(texts: pa.Array) -> pa.Array:
    n = len(texts)
    size = np.zeros(n, np.int64)
    digest = np.zeros((n, 2), np.uint64)
    bands = np.zeros((n, BANDS), np.uint64)
    sign = np.zeros((n, HASHES), np.uint16)
    for lo, h, text in shingle_sets(texts):
        if not len(h):
            continue
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        at = lo + text[starts]
        size[at] = np.diff(np.concatenate([starts, [len(h)]]))
        digest[at] = _digests(h, starts)
        tmp = np.empty_like(h)
        for k in range(BANDS * ROWS + HASHES):
            np.bitwise_xor(h, _SEEDS[2 * k], out=tmp)
            np.multiply(tmp, _SEEDS[2 * k + 1] | np.uint64(1), out=tmp)
            least = np.minimum.reduceat(tmp, starts)
            if k < BANDS * ROWS:
                bands[at, k // ROWS] = W.mix64(bands[at, k // ROWS] * np.uint64(31) + (least >> np.uint64(16)) + np.uint64(1))
            else:
                sign[at, k - BANDS * ROWS] = W.mix64(least >> np.uint64(16)).astype(np.uint16)
    keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
    return pa.StructArray.from_arrays(
        [pa.array(size), _binary(digest.view(np.uint8), 16), keys, _binary(sign.view(np.uint8), 2 * HASHES)], names=["n_shingles", "node", "bands", "sign"])


def _binary(rows: np.ndarray, width: int) -> pa.Array:
    n = len(rows)
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


_SIGNED = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()),
                        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sign", T.BinaryType())])
signed = F.arrow_udf(_sign, _SIGNED)


def _rows(a: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(a.to_pylist()), dtype=np.uint16).reshape(len(a), width)


_LEAST = least_matches()


def sequential(a: np.ndarray, b: np.ndarray, least_of: list[int] = _LEAST) -> np.ndarray:
    """Indices of the rows of two signature tables that survive every batch (``least_of``: of the threshold)."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for i, least in enumerate(least_of):
        cols = slice(BATCH * i, BATCH * (i + 1))
        matches = matches + (a[alive, cols] == b[alive, cols]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def plausible(a: F.Column, b: F.Column, percent: int = PERCENT) -> F.Column:
    """Whether the signatures of a pair survive every batch."""
    least_of = least_matches(percent / 100)

    @F.arrow_udf(T.BooleanType())
    def check(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a), dtype=bool)
        if len(a):
            out[sequential(_rows(a, HASHES), _rows(b, HASHES), least_of)] = True
        return pa.array(out)

    return check(a, b)


def components(links: DataFrame, name: str = "near-dup-labels") -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b); the root is the least node reachable.

    Least-label propagation with pointer jumping; each round's labels are
    written to the shared folder, and only whether one changed reaches the driver.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), name)
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("heard"))
        step = labels.join(heard, labels.node == heard.a).select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        for k in range(2):
            jump = labels.select(F.col("node").alias(f"__n{k}"), F.col("root").alias(f"__r{k}"))
            step = step.join(jump, F.col("root") == F.col(f"__n{k}")).select("node", "old", F.least("root", f"__r{k}").alias("root"))
        step = written(step, name)
        labels = step.select("node", "root")
        if step.where("root <> old").isEmpty():
            return labels


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` after further links: only links between different components count."""
    if roots is None:
        return components(links)
    at = lambda c: roots.select(F.col("node").alias(f"__{c}"), F.col("root").alias(f"__r{c}"))
    between = (links.join(at("a"), F.col("a") == F.col("__a"), "left").join(at("b"), F.col("b") == F.col("__b"), "left")
               .select(F.coalesce("__ra", "a").alias("a"), F.coalesce("__rb", "b").alias("b")).where("a <> b").distinct())
    higher = components(between).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    moved = roots.join(higher, F.col("root") == F.col("__node"), "left").select("node", F.coalesce("__root", "root").alias("root"))
    new = higher.join(roots, F.col("__node") == F.col("root"), "left_anti").select(F.col("__node").alias("node"), F.col("__root").alias("root"))
    return written(moved.union(new), "near-dup-roots")


def _sets(docs: DataFrame, nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, hashes) of the given nodes, made again from the texts of their owners."""
    # a merge join at every size: the owners grow with the corpus, and a plan that
    # broadcasts them while they are few would cost more than it promises later
    owner = nodes.join(owners, "node").select("owner").distinct().hint("merge")
    texts = docs.join(owner, docs.doc_id.eqNullSafe(owner.owner), "left_semi")
    sets = texts.select(_shingled(F.col("text")).alias("s")).select("s.*").join(nodes, "node", "left_semi")
    return written(sets.dropDuplicates(["node"]), "near-dup-sets")


def _verify(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, c) whose full sets reach ``percent``.

    ``sizes`` has (node, n_shingles), ``sets`` (node, hashes).  A centre with
    many members is salted, so that what travels to one copy of its set is
    bounded; copies of small ones share a group.
    """
    groups = 4 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = pairs.join(sizes.select(F.col("node").alias("a"), "n_shingles"), "a")
    salts = sized.groupBy("c").agg(F.ceil(F.sum("n_shingles") / GROUP_SHINGLES).cast("int").alias("k"))
    salted = sized.join(salts, "c").select("a", "c", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("salt"))
    group = lambda c: F.pmod(F.xxhash64(c, "salt"), F.lit(groups)).alias("group")
    left = salted.select("a", "c", group("c")).join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a")
    copies = salts.select(F.col("c").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    right = (copies.select("centre", group("centre").alias("part")).distinct()
             .join(sets.select(F.col("node").alias("centre"), F.col("hashes").alias("right")), "centre"))

    def check(members: pa.Table, centres: pa.Table) -> pa.Table:
        centre = {c: np.frombuffer(h, np.uint64) for c, h in zip(centres.column("centre").to_pylist(), centres.column("right").to_pylist(), strict=True)}
        keep = []
        for i, (c, x) in enumerate(zip(members.column("c").to_pylist(), members.column("left").to_pylist(), strict=True)):
            whole, s = centre[c], np.frombuffer(x, np.uint64)
            at = np.searchsorted(whole, s)
            at[at == len(whole)] = 0
            common = int((whole[at] == s).sum())
            if 100 * common >= percent * (len(whole) + len(s) - common):
                keep.append(i)
        return members.select(["a", "c"]).take(pa.array(keep, pa.int64()))

    return left.groupBy("group").cogroup(right.groupBy("part")).applyInArrow(check, "a binary, c binary").select(F.col("a"), F.col("c").alias("b"))


@F.arrow_udf(T.StructType([T.StructField("node", T.BinaryType()), T.StructField("hashes", T.BinaryType())]))
def _shingled(texts: pa.Array) -> pa.Array:
    nodes: list[bytes | None] = [None] * len(texts)
    sets: list[bytes | None] = [None] * len(texts)
    for lo, h, text in shingle_sets(texts):
        if len(h):
            starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            ends = np.concatenate([starts[1:], [len(h)]])
            for i, (s, e, d) in enumerate(zip(starts, ends, _digests(h, starts), strict=True)):
                at = lo + int(text[s])
                nodes[at], sets[at] = d.tobytes(), h[s:e].tobytes()
    return pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "hashes"])


def _common(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others (none empty)."""
    flat = np.concatenate(many)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    starts = np.concatenate([[0], np.cumsum([len(m) for m in many[:-1]])]).astype(np.int64)
    return np.add.reduceat((one[at] == flat).astype(np.int64), starts)


def _links_between(band: int, x: np.ndarray, y: np.ndarray | None, root: np.ndarray, size: np.ndarray, sign: np.ndarray,
                   bands: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Verified links among ``x`` (``y`` None) or between ``x`` and ``y`` that join what was apart.

    A pair belongs to the first band whose key it shares, so it is compared
    once; what a link has joined is not compared again.  So at most one link
    for each member comes out, however many are similar.
    """
    root = root.copy()
    least_of = least_matches(percent / 100)
    out = []
    for k, one in enumerate(x):
        many = x[k + 1:] if y is None else y
        many = many[(root[many] != root[one]) & (100 * np.minimum(size[many], size[one]) >= percent * np.maximum(size[many], size[one]))]
        if len(many):
            many = many[sequential(sign[many], np.broadcast_to(sign[one], (len(many), HASHES)), least_of)]
        if len(many) and band:
            many = many[~(bands[many, :band] == bands[one, :band]).any(axis=1)]
        if not len(many):
            continue
        common = _common(sets[one], [sets[m] for m in many])
        for m in many[100 * common >= percent * (size[many] + size[one] - common)]:
            if root[m] != root[one]:
                out.append((int(one), int(m)))
                root[root == root[m]] = root[one]
    return out


def _rest(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among members (bucket, band, node, root, n_shingles, sign, bands, hashes) of different roots.

    A bucket of many (or long) members is cut into blocks; a task compares two
    blocks on signatures and full sets and returns the links that join them.
    """
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    counts = members.groupBy("bucket").agg(size.alias("k"))
    own = members.join(counts, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "node", "root", "n_shingles", "sign", "bands", "hashes")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        block, i, j, band = t.column("block").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("band")[0].as_py()
        links = _links_between(
            band, np.flatnonzero(block == i), None if i == j else np.flatnonzero(block == j), np.unique(t.column("root").to_pylist(), return_inverse=True)[1],
            t.column("n_shingles").to_numpy(), _rows(t.column("sign"), HASHES), t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS),
            [np.frombuffer(h, np.uint64) for h in t.column("hashes").to_pylist()], percent)
        node = t.column("node").combine_chunks()
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.table([node.take(pa.array(at[:, 0])), node.take(pa.array(at[:, 1]))], schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return spread.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_hash, n_shingles, component_id, kept, root.

    Texts with equal sets, and sets of similarity ``percent`` / 100 or more, are
    linked; component_id is the least doc_id reachable and ``kept`` marks it.
    Null and empty texts have no set and are linked with nothing.  A null doc_id
    never is a component's least unless all are null; repeated rows share a
    component.  ``text_hash`` (xxhash64) tells rows of one doc_id apart, ``root``
    names the component (null without a set).  Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    base = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), signed(F.col("text")).alias("s")).select("doc_id", "text_hash", "s.*"), "near-dup-signatures")
    full = base.where("n_shingles > 0")
    classes = written(full.groupBy("node").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("copies")), "near-dup-classes")
    # one row a class, with signature and bands: those of its owner
    rep = (full.join(classes, "node").where(F.col("doc_id").eqNullSafe(F.col("owner"))).select("node", "n_shingles", "bands", "sign").dropDuplicates(["node"]))
    rep = written(rep, "near-dup-representatives")
    signs = rep.select("node", "n_shingles", "sign")
    member = rep.select("node", F.posexplode("bands").alias("band", "key")).select("node", "band", F.xxhash64("band", "key").alias("bucket"))
    crowded = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    member = written(member.join(crowded, "bucket"), "near-dup-buckets")
    crowd = member.select("node").distinct()

    roots: DataFrame | None = None  # (node, root) of the nodes with links
    sets: DataFrame | None = None
    for star in range(STARS + 1):
        known = member if roots is None else member.join(roots, "node", "left")
        known = known.select("bucket", "band", "node", (F.col("node") if roots is None else F.coalesce("root", "node")).alias("root"))
        mixed = known.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("node", F.lit(star)), "node")).alias("c"))
        mixed = mixed.where("lo <> hi").select("bucket", F.col("c.node").alias("centre"))
        open_ = written(known.join(mixed, "bucket"), "near-dup-open")
        if open_.isEmpty():
            break
        if star < STARS:
            centre_root = open_.where("node = centre").select("bucket", F.col("root").alias("centre_root"))
            pairs = open_.join(centre_root, "bucket").where("root <> centre_root").select(F.least("node", "centre").alias("c"), F.greatest("node", "centre").alias("a")).distinct()
            pairs = (pairs.join(signs.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sign").alias("sa")), "a")
                     .join(signs.select(F.col("node").alias("c"), F.col("n_shingles").alias("nc"), F.col("sign").alias("sc")), "c")
                     .where(F.lit(100) * F.least("na", "nc") >= F.lit(percent) * F.greatest("na", "nc"))
                     .where(plausible(F.col("sa"), F.col("sc"), percent)).select("a", "c"))
            # the centre has met every member of its bucket
            member = open_.where("node <> centre").select("bucket", "band", "node")
            pairs = written(pairs, "near-dup-pairs")
            if pairs.isEmpty():
                continue
        if sets is None:
            sets = _sets(docs, crowd, classes.select("node", "owner"))
        found = _verify(pairs, signs, sets, percent) if star < STARS else _rest(open_.join(rep, "node").join(sets, "node"), percent)
        found = written(found, "near-dup-links")
        if not found.isEmpty():
            roots = _merged(roots, found)

    if roots is None:
        named = classes.select("node", F.col("owner").alias("component_id"), F.col("node").alias("root"))
    else:
        rooted = classes.join(roots, "node", "left").select("node", "owner", F.coalesce("root", "node").alias("root"))
        least = rooted.groupBy("root").agg(F.min("owner").alias("component_id"))
        named = rooted.join(least, "root").select("node", "component_id", "root")
    out = base.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "root")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one with the least doc_id.

    Rows that share that id count as one document (the least text_hash stays).
    All columns are kept.
    """
    kept = near_duplicates(docs, percent).where("kept").groupBy("root", "doc_id").agg(F.min("text_hash").alias("__hash")).select(F.col("doc_id").alias("__id"), "__hash").distinct()
    cols = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.select(*cols, F.xxhash64("text").alias("__text_hash"))
    joined = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    return joined.dropDuplicates(["doc_id", "__text_hash"]).select(*cols)


def op5_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over all whole texts of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
, sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0)
, n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id)
, pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)
, links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i))
, ab AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)
, reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT ab.b, reach.other FROM reach JOIN ab ON ab.a = reach.doc_id)
, c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""
