"""Token files, WARC bundles, near-duplicates and the pipeline: round trips and brute force."""

import base64
import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from conftest import SF_SMALL
from pairlab.llm import files, near_dup, quality, token_codec, warc
from pairlab.llm.base import shared_path
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n", "a\x0bb", "<|endoftext|> x<|startoftext|>y", "É́ é", "́abc x́", "ΑΣ ΣΑΣ. don't we'll 12 3", "x\x1cy\x85z  q", "\U0001F600 ok İstanbul", "w " * 9000]


def coded(ids):
    """Blocks, and the ids that come back from them and from the written classes."""
    classes = token_codec.Classes.count(ids)
    blocks = token_codec.encode_blocks(ids, classes)
    sizes = [min(token_codec.BLOCK, len(ids) - i) for i in range(0, len(ids), token_codec.BLOCK)]
    return blocks, token_codec.decode_blocks(blocks, sizes, token_codec.Classes.from_bytes(classes.to_bytes()))


@pytest.mark.parametrize("ids", [[], [0], [1, 2, 3], [5] * 9000, [2**20 - 1, 0, 7] * 50, list(range(5000)), [0, 65535] * 2049, [0] * 70000 + list(range(40000))])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.int64)
    assert (coded(ids)[1] == ids).all()


def test_random_ids_round_trip_and_predictable_ones_shrink():
    rng = np.random.default_rng(4)
    for n, high in ((token_codec.BLOCK * 3, 50000), (token_codec.BLOCK + 1, 3), (777, 2**16), (token_codec.BLOCK * 20, 2**17)):
        ids = rng.integers(0, high, n)
        assert (coded(ids)[1] == ids).all()
    phrase = rng.integers(0, 50000, 40)
    assert sum(map(len, coded(np.tile(phrase, 300))[0])) * 8 < 2 * 40 * 300
    skewed = np.minimum(rng.geometric(0.05, token_codec.BLOCK * 4), 60)  # 5.8 bits an id
    assert sum(map(len, coded(skewed)[0])) * 8 < 6.6 * len(skewed)


def test_a_block_stands_alone():
    ids = np.random.default_rng(1).integers(0, 999, token_codec.BLOCK * 3)
    classes = token_codec.Classes.count(ids)
    blocks = token_codec.encode_blocks(ids, classes)
    assert (token_codec.decode_blocks(blocks[1:2], [token_codec.BLOCK], classes) == ids[token_codec.BLOCK:2 * token_codec.BLOCK]).all()


def _mixed_ids():
    at = np.arange(30_000, dtype=np.int64)
    return np.where(at % 5 < 2, at % 11, at * at * 7919 % 30_011)


def test_blocks_keep_their_bytes_and_state_is_narrow():
    """The file format is as it was; a block's classes are one line of 16-bit numbers, not a column of wider ones."""
    ids = _mixed_ids()
    blocks, back = coded(ids)
    assert (back == ids).all() and zlib.crc32(b"".join(blocks)) == 970496580
    model = token_codec._Model(7, token_codec.Classes.count(ids))
    assert model.rows.shape == (7, token_codec.CLASSES) and model.rows.dtype == np.int16 and model.rows.flags.c_contiguous
    below, share = model.part(np.arange(7), np.arange(9, 16))
    assert (below + share == np.arange(10, 17) << 10).all()


def test_garbage_decodes_to_something():
    """Damaged blocks reach the checksum, whatever their bytes are."""
    classes, rng = token_codec.Classes.count(_mixed_ids()), np.random.default_rng(8)
    for payloads in ([rng.bytes(4000), b"", rng.bytes(20)], [b"\xff" * 8000] * 2, [bytes(8000)]):
        assert len(token_codec.decode_blocks(payloads, [token_codec.BLOCK] * len(payloads), classes)) == token_codec.BLOCK * len(payloads)


def test_distinct_hashes():
    for h in (np.zeros(0, np.uint64), np.random.default_rng(2).integers(0, 50, 900).astype(np.uint64) << np.uint64(58)):
        found, where, back = token_codec._distinct(h)
        assert (found == np.unique(h)).all() and (h[where] == found).all() and (found[back] == h).all()


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice("aB é\n.'s12ñ́€ ") for _ in range(rng.randrange(50))) for _ in range(500)]
    want = Tokenizer.from_file(TOKENIZER).encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = list(token_codec.WordEncoder(TOKENIZER).encode(pa.array(texts)))
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_damage_is_noticed(tmpdir_fresh):
    path = f"file://{tmpdir_fresh}/a.tok"
    w = token_codec.TokenWriter(path)
    w.add(5, np.arange(900))
    w.add(None, np.array([1]))
    w.close()
    assert [(d, x.tolist()) for d, x in token_codec.read_tokens(path)] == [(5, list(range(900))), (None, [1])]
    raw = bytearray(open(f"{tmpdir_fresh}/a.tok", "rb").read())
    raw[200] ^= 1
    open(f"{tmpdir_fresh}/a.tok", "wb").write(raw)
    with pytest.raises(ValueError):
        list(token_codec.read_tokens(path))


def expected_tokens(rows):
    from tokenizers import Tokenizer
    out, start = {}, 0
    rows = sorted(rows, key=lambda r: r[0])
    for (i, _), e in zip(rows, Tokenizer.from_file(TOKENIZER).encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 1], "<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_token_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_codec.op3_token_range_coder(spark, SF_SMALL).collect()}
    assert got == expected_tokens(docs)


def test_token_files_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "null id"), (-4, "first")]
    out = token_codec.read_token_files(token_codec.write_token_files(spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(1)), shared_path(spark, "t"), TOKENIZER)).collect()
    encoder = token_codec.WordEncoder(TOKENIZER)
    want = collections.Counter((d, zlib.crc32(np.append(ids, 1).astype("<u4").tobytes())) for (d, _), ids in zip(rows, encoder.encode(pa.array([t for _, t in rows])), strict=True))
    assert collections.Counter((r.doc_id, zlib.crc32(r.ids)) for r in out) == want
    empty = token_codec.write_token_files(spark.createDataFrame([], DOCS), shared_path(spark, "t"), TOKENIZER)
    assert empty.collect() == [] and token_codec.read_token_files(empty).collect() == []


PAGES = "page_id long, url string, html string"


def test_warc_edge_cases(spark):
    rows = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (None, "n", "<p>é</p>"), (5, "v", "\r\n\r\nWARC/1.1\r\n"), (6, "w", "x" * 600000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("refers_to", F.lit("clash"))
    index = warc.write_warc(warc.with_revisits(pages), shared_path(spark, "w"))
    out = warc.read_warc(index).collect()
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in out)
    assert got == collections.Counter([(1, "revisit", 4, 9), (2, "revisit", 3, 0), (3, "response", None, 0), (4, "response", None, 9), (4, "response", None, 9),
                                       (None, "revisit", 4, 9), (5, "response", None, 14), (6, "response", None, 600000)])
    for r in out:
        if r.record_type == "response":
            html = next(h for p, _, h in rows if p == r.page_id)
            assert bytes(r.payload) == (html or "").encode()
    some = index.where("page_id IN (3, 6)")
    assert {(r.page_id, r.payload_bytes) for r in warc.fetch_records(some).collect()} == {(3, 0), (6, 600000)}
    assert warc.read_warc(warc.write_warc(warc.with_revisits(spark.createDataFrame([], PAGES)), shared_path(spark, "w"))).collect() == []
    assert warc.with_revisits(pages, least_bytes=10).where("refers_to IS NOT NULL").count() == 0


def test_bundles_are_zstandard_with_a_seek_table(tmpdir_fresh):
    import zstandard
    w = warc.BundleWriter(f"file://{tmpdir_fresh}/b.warc.zst")
    records = [warc.format_record(i, f"http://h/{i}", bytes([i]) * 70000, "D", None) for i in range(20)]
    places = [w.add(r) for r in records]
    w.close()
    raw = open(f"{tmpdir_fresh}/b.warc.zst", "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(records)
    assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
    r = warc.BundleReader(f"file://{tmpdir_fresh}/b.warc.zst")
    assert len(r.frames) > 3
    for record, (frame, at) in zip(records, places, strict=True):
        assert r.frame(frame)[at:at + len(record)] == record


def test_warc_query(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    by = collections.defaultdict(list)
    for p in pages:
        by[(p.html or "").encode()].append(p.page_id)
    want = {(i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if i == max(v) else "revisit", None if i == max(v) else max(v)) for h, v in by.items() for i in v}
    assert {tuple(r) for r in warc.op10_seekable_warc(spark, SF_SMALL).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == want


def test_unnamed_files_do_not_count(spark):
    folder = shared_path(spark, "w")
    index = warc.write_warc(warc.with_revisits(spark.createDataFrame([(1, "u", "a")], PAGES)), folder)
    with files.open_out(f"{folder}/part-000000-left-by-a-lost-task.warc.zst") as f:
        f.write(b"half a frame")
    assert [r.page_id for r in warc.read_warc(index).collect()] == [1]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    least = {r: min([d for d in v if d is not None], default=None) for r, v in least.items()}
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(seed, n=60, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    while len(out) < n:
        w = rng.choice(out).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    """Chains and crowds of copies near the threshold, where links are sparse."""
    texts = near_copies(seed) + near_copies(seed + 50, words=60) + [None, "", " ", "a b", "A  b", "a b c", "a b c d e", "x y", None]
    rows = [((i * 37) % 1009, t) for i, t in enumerate(texts)] + [(5000, texts[0]), (0, texts[0]), (None, texts[1]), (None, "alone")]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(3))).collect())
    want = brute_components(rows)
    want = collections.Counter((d, n, c if n else d) for d, n, c in want)
    assert got == want


def test_rest_after_the_stars(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "STARS", 0)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rows = list(enumerate(near_copies(9, n=70)))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: c for d, _, c in brute_components(rows)}


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert near_dup.near_duplicates(spark.createDataFrame([(1, None), (2, "")], DOCS)).where("kept").count() == 2


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**16, (20000, near_dup.HASHES)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.85, a, a + 1)
    assert len(near_dup.sequential(a, b)) >= 19990
    assert len(near_dup.sequential(a, np.where(rng.random(a.shape) < 0.3, a, a + 1))) < 20


def test_one_of_each_group(spark):
    rows = [(3, "a b c d e f g"), (3, "a b c d e f g"), (1, "other words are here now ok"), (2, "a b c d e f g"), (9, None), (8, ""), (2, "different text with the same id")]
    got = collections.Counter((r.doc_id, r.text) for r in near_dup.one_of_each(spark.createDataFrame(rows, DOCS)).collect())
    assert got == collections.Counter([rows[2], rows[3], rows[4], rows[5], rows[6]])


@pytest.mark.parametrize("stars", [0, near_dup.STARS])
def test_pipeline_drops_copies_of_similarity_80_to_85(spark, stars, monkeypatch):
    monkeypatch.setattr(near_dup, "STARS", stars)
    rng = random.Random(4)
    rows, low = [], set()
    for k in range(12):
        w = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        edited = [x if i not in (20, 60, 100, 140) else "zz" for i, x in enumerate(w)]  # 4 edits take 20 of 200 shingles: 180 of 220 are common
        far = [x if i not in (20, 50, 80, 110, 140) else "yy" for i, x in enumerate(w)]  # 175 of 225
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(edited if k % 2 else far))]
        low |= {10 * k + 1} if k % 2 == 0 else set()
        n = len(shingles(rows[-1][1]) & shingles(rows[-2][1]))
        assert (80 <= 100 * n / (400 - n) < 85) == bool(k % 2)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, SF_SMALL).collect()}
    assert got == {10 * k for k in range(12)} | low
    assert near_dup.near_duplicates(docs).where("kept").count() == len(rows)  # op5 keeps its 0.85


def test_near_duplicate_query_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.op5_bayes_minhash(spark, SF_SMALL).collect()}
    assert got == {d: (n, c, d == c) for d, n, c in brute_components(docs)}


def test_read_back_joins_nothing(spark):
    plan = token_codec.read_token_files(spark.createDataFrame([], "file string, part int, n_ids long"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_pipeline(spark):
    from pairlab.llm import decontaminate, mix
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        out = stage(spark, kept, SF_SMALL)
        rows = out.collect()
        ids = collections.Counter(r.doc_id for r in rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
            assert all(before[r.doc_id] == r for r in rows)
        if name == "quality rules":
            good = {r.doc_id for r in quality.op8_rule_ledger(spark, SF_SMALL).where("kept").collect()}
            assert ids == collections.Counter(good)
        if name == "near duplicates":
            want = brute_components([(r.doc_id, r.text) for r in before.values()], corpus_pipeline.NEAR_PERCENT)
            assert ids == collections.Counter({c if n else d for d, n, c in want})
        if name == "benchmark leaks":
            leaked = {r.doc_id for r in decontaminate.find_leaks(kept, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
            assert set(ids) == set(before) - leaked and max(ids.values()) == 1
        if name == "mix":
            assert max(ids.values()) <= mix.MAX_EPOCHS
        if name == "shards":
            assert sum(ids.values()) == kept.count()
            assert all(0 <= r.shard < 40 for r in rows)
        kept = spark.createDataFrame(rows, out.schema)
    final = collections.Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, SF_SMALL).collect())
    assert final == collections.Counter((r.doc_id, r.shard) for r in rows)


def test_pipeline_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = " ".join(f"word{i}" for i in range(30))
    odd = spark.createDataFrame([(1, clean, None, None, None), (1, clean, None, None, None), (None, clean + " more", "en", "s", 1), (2, None, "en", "s", 0)], schema).withColumn("shard", F.lit("x"))
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF_SMALL)
            assert out.columns[:5] == corpus_pipeline.COLUMNS
            assert (out.count() > 0) == (table is odd), name
