"""Quality ledger, personal data, automaton scores and decontamination against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL
from pairlab.llm import decontaminate, lm, pii, quality, words
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "one", "a b c d", "a b c d e", "é ü\u00a0x \u2028y z", "x " * 3000, "A b\nA b\n\nA b \n c", "a b c d e f a b c d e f " * 3,
         "# $ | <x>", "long" * 30000, "\x0b\x0c\x1c q", "the the the the the the the the the the the"]
DOCS = "doc_id long, text string"


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_word_scan():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab é\n\t\x1c.A") for _ in range(rng.randrange(40))) for _ in range(300)]
    seen = {}
    n = 0
    for w in words.scan(pa.array(texts), lower=True):
        for i in range(len(w.first) - 1):
            want = WORD.findall(lower(texts[w.lo + i]))
            got = w.hash[w.first[i]:w.first[i + 1]].tolist()
            assert len(got) == len(want)
            for h, x in zip(got, want, strict=True):
                assert seen.setdefault(x, h) == h
            n += 1
    assert n == len(texts) and len(set(seen.values())) == len(seen)


def base_measures(t):
    t = t or ""
    ws = WORD.findall(t)
    grams = collections.Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    cover = {j for i in range(len(ws) - 4) if grams[tuple(ws[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_ledger(spark):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[5]), (None, "a b")]
    df = spark.createDataFrame(rows, DOCS).withColumn("fails", F.lit("clash")).withColumn("n_words", F.lit(None).cast("int"))
    out = quality.quality_ledger(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_measures(r.text)
        assert bool(r.fails & 1) == (r.n_words < 10) and bool(r.fails >> 1 & 1) == (100 * r.n_repeat_words > 20 * r.n_words)
    assert quality.quality_ledger(spark.createDataFrame([], DOCS)).collect() == []


def test_ledger_query_and_ablations(spark):
    docs = documents(spark)
    rows = quality.op8_rule_ledger(spark, SF_SMALL).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        m = base_measures(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert all(k for k, q in judged if q == 1) and sum(k == q for k, q in judged) >= 0.97 * len(judged)
    ledger = spark.createDataFrame([(r.fails,) for r in rows], "fails long")
    mask = quality.policy_mask("v1")
    for a in quality.ablations(ledger).collect():
        bit = 1 << list(quality.RULES).index(a.rule)
        assert a.n_fail == sum(bool(r.fails & bit) for r in rows) and a.n_only == sum((r.fails & mask) == bit for r in rows)
        assert a.n_rejected + a.n_kept == len(rows)
    assert quality.apply_policy(ledger).count() == sum(not r.fails & mask for r in rows)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 16 <= len(d) <= 19 and pii.luhn(d.encode()), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_patterns_on_random_strings():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aé._%+-@ 0123456789.-()4\n") for _ in range(rng.randrange(70))) for _ in range(4000)]
    texts += [None, "", "4111 1111-1111 1111", "x4111111111111111y 1.2.3.4.5.6.7.8 +1 (212) 555-0100", "a@b.c.d@e.f_g@h.i", "1" * 9000, "a" * 9000 + "@", "000000255.1.1.1 256.1.1.1"]
    kinds = list(PATTERNS)
    for t, ms in zip(texts, pii.mentions_of(pa.array(texts)), strict=True):
        got = [f"{kinds[m['kind']]}:{m['start']}:{m['end']}" for m in sorted(ms, key=lambda m: (m["kind"], m["start"])) if m["seed"]]
        assert got == base_spans(t), t


def test_pii_query(spark):
    docs = documents(spark)
    rows = pii.op1_bootstrapped_pii(spark, SF_SMALL).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        want = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) or not want
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in want) for k in PATTERNS)


def test_bootstrapping_finds_identifiers_by_context(spark):
    numbers = [f"+1 (212) 555-01{i:02d}" for i in range(12)]
    rows = [(i, f"word{i} please call me at {n} today") for i, n in enumerate(numbers)]
    rows += [(100, "nothing else, but call me at 212-555-0199 today"), (101, "the total was 212-555-0199 units"), (102, "version 212-777-0199 of it"), (103, None), (104, "")]
    out = {r.doc_id: r.spans for r in pii.extract_pii(spark.createDataFrame(rows, DOCS).withColumn("kind", F.lit(1))).collect()}
    assert [(s.kind, s.seed, rows[12][1][s.start:s.end]) for s in out[100]] == [(3, False, "212-555-0199")]
    assert len(out[101]) == 1  # the same number elsewhere is the same instance
    assert out[102] == [] and out[103] == [] and out[104] == []
    copies = [(i, "call us at 212-555-0199 now") for i in range(50)] + [(i, "call us at +1 212 555 0100 now") for i in range(50, 99)]
    assert all(s.seed for r in pii.extract_pii(spark.createDataFrame(copies, DOCS)).collect() for s in r.spans)  # copies are one piece of evidence
    assert pii.extract_pii(spark.createDataFrame([], DOCS)).collect() == []


def test_instances_with_many_good_patterns_and_other_mentions_of_seeds(spark):
    schema = "seed boolean, instance long, patterns array<long>"
    edges = [(True, 1000 + i, list(range(50))) for i in range(4)] + [(False, 7, list(range(50))), (False, 8, [99])]
    got = {r.instance: (r.score, r.seed) for r in pii.bootstrap(spark.createDataFrame(edges, schema)).collect()}
    assert got[7] == (1.0, False) and 8 not in got  # 50 patterns of precision 4/6: the noisy-or is 1 in double precision
    assert {i for i, (_, seed) in got.items() if seed} == {1000, 1001, 1002, 1003}
    rows = [(100 * k + i, f"please topic{chr(97 + k // 8)}{chr(97 + k % 8)} contact +1 (212) 555-01{i:02d} today") for k in range(50) for i in range(4)]
    rows += [(10000 + k, f"please topic{chr(97 + k // 8)}{chr(97 + k % 8)} contact 212-555-0199 today") for k in range(50)]
    rows += [(20000, "number 1 212 555 0101 in a list"), (20001, "number 1 212 555 0177 in a list")]
    out = {r.doc_id: [(s.kind, s.seed, s.score) for s in r.spans] for r in pii.extract_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[10000 + k] == [(3, False, 1.0)] for k in range(50))
    assert out[20000] == [(3, False, 1.0)] and out[20001] == []  # a seed written without + is the same number


def test_plain_digits_and_long_chains(spark):
    link = lambda k: [3 * k, 3 * k + 1, 3 * k + 2]  # noqa: E731  three patterns that groups k - 1 and k share
    chain = [(k == 0, 10 * k + i, link(k) + link(k + 1)) for k in range(7) for i in range(5)]
    found = pii.bootstrap(spark.createDataFrame(chain, "seed boolean, instance long, patterns array<long>"), precision=0.3, score=0.65).collect()
    assert {r.instance for r in found} == {r[1] for r in chain}  # six rounds
    rows = [(i, f"word{i} please call me at +1 (212) 555-01{i:02d} today") for i in range(12)]
    rows += [(100, "just call me at 2125550199 today"), (101, "just call me at 212555019912345 today"), (102, "order 3125550199 of it")]
    out = {r.doc_id: [(s.kind, s.seed, rows[12][1][s.start:s.end]) for s in r.spans] for r in pii.extract_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[100] == [(3, False, "2125550199")] and [k for k, _, _ in out[101]] == [3] and out[102] == []


def brute_scores(docs, held, order, strength):
    toks = [WORD.findall(lower(t)) + ["</s>"] for t in docs]
    count = collections.Counter()
    for x, h in zip(toks, held, strict=True):
        if not h:
            s = ["<s>", *x]
            for k in range(1, order + 1):
                count.update(tuple(s[i:i + k]) for i in range(len(s) - k + 1))
    single = {g[0]: n for g, n in count.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(single.values()), len(single)
    out = []
    for x in toks:
        s, base, score = ["<s>", *x], 0.0, 0.0
        for i in range(1, len(s)):
            p = (single.get(s[i], 0) + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(2, min(order, i + 1) + 1):
                p = (count[tuple(s[i - k + 1:i + 1])] + strength * p) / (count[tuple(s[i - k + 1:i])] + strength)
            score += math.log10(p)
        out.append((len(x), sum(w in single for w in x), n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order, monkeypatch):
    texts = [*TEXTS, "a b c", "a b c", "A B d", "the cat the dog"]
    held = [i % 3 == 1 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS).withColumn("train", F.lit("clash"))
    got = {r.doc_id: r for r in lm.score_texts(df, F.col("doc_id") % 3 != 1, order=order, strength=3.0).collect()}
    for i, (n, known, tokens, base, score) in enumerate(brute_scores(texts, held, order, 3.0)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (n, known, tokens, not held[i])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_score_query_beats_the_base_on_held_out_text(spark):
    docs = documents(spark)
    rows = lm.op2_backoff_automaton(spark, SF_SMALL).collect()
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_nothing(spark):
    assert lm.score_texts(spark.createDataFrame([], DOCS), F.lit(True)).collect() == []
    only = lm.score_texts(spark.createDataFrame([(None, None), (3, "a")], DOCS), F.lit(None).cast("boolean")).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in only} == {(None, 1, 0, 0), (3, 2, 0, 0)}


def test_blocks_cut_anywhere(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 64)
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(a, a + 20)), "train": [True] * 20, "text": [f"w{i} " * (i % 9) for i in range(a, a + 20)]}) for a in (0, 20)]
    blocks = list(lm._blocks(iter(batches)))
    assert len(blocks) > 4 and [d for b in blocks for d in b.to_pylist()[0]["doc_ids"]] == list(range(40))
    assert len({b.to_pylist()[0]["block"] for b in blocks}) == len(blocks)


def tokens(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(t))


def nearest(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_with_edits_are_found_and_others_are_not():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12, 70))) for _ in range(40)]
    bench = decontaminate.compile_benchmark(list(range(40)), items)
    texts, want = [], set()
    for k in range(300):
        w = items[k % 40].split()
        for _ in range(int(rng.choice([0, 0.1, 0.19, 0.4]) * len(w))):
            i = rng.randrange(len(w))
            w[i:i + 1] = rng.choice([[], ["zz"], [w[i], "yy"]])
        around = [rng.choice(vocabulary) for _ in range(120)]
        texts.append(" ".join([*around[:60], *w, *around[60:]]) + "!!")
        for i, item in enumerate(items):
            if len(set(zip(item.split(), item.split()[1:], strict=False)) & set(zip(w, w[1:], strict=False))) > 2 and nearest(item.split(), texts[-1].rstrip("!").split()) <= decontaminate.edits(len(item.split())):
                want.add((k, i))
    got = {(t, i): d for t, i, d, _, _ in decontaminate.leaks_of(bench, pa.array(texts))}
    assert set(got) <= want and len(got) >= 0.99 * len(want) > 100


def test_blocks_of_items_equal_one_block(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    rows = lambda: collections.Counter(tuple(r) for r in decontaminate.find_leaks(docs, bench.repartition(3)).collect())
    one = rows()
    compiled = decontaminate._compile
    monkeypatch.setattr(decontaminate, "_compile", lambda folder: _small_blocks(compiled, folder))
    assert one and rows() == one


def _small_blocks(compiled, folder):
    """The same in blocks of a few items."""
    def few(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4):
                yield from compiled(folder)(iter([b.slice(i, 4)]))
    return few


def test_leak_query_equals_exact_distances(spark):
    def words_of(t):
        return np.concatenate([np.zeros(0, np.uint64), *[h for _, h, _ in decontaminate._words(pa.array([t or ""]))]])

    docs = {r.doc_id: words_of(r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()}
    want = set()
    for i, item in items.items():
        for d, text in docs.items():
            if len(item) and len(np.intersect1d(item, text)) >= len(np.unique(item)) - 2 * decontaminate.edits(len(item)):
                distance = decontaminate.edit_distance(item, text)[0]
                if distance <= (decontaminate.edits(len(item)) if len(item) >= decontaminate.SHORT else 0):
                    want.add((d, i, distance))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.op4_cgk_leaks(spark, SF_SMALL).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and want


def test_automaton_walks_failure_arcs():
    # training: "a b" twice, "c" once; states: the root, the start, a, b, c and contexts of two
    ids = np.array([0, 1, 0, 1, 2, 0, 2], np.uint32)
    stream = lm._Stream(ids.tobytes(), np.array([11, 22, 33], np.uint64).tobytes(), np.array([2, 2, 1, 2], np.int64).tobytes(), [True, True, True, False])
    counts = []
    for k in (1, 2, 3):
        grams, at, index = stream.grams(k)
        counts.append(np.bincount(index[stream.train[at]], minlength=len(grams)).astype(float))
    m = lm.Automaton(stream, counts, 3, 2.0, 8, 4)
    assert len(m.fail) == len(m.fail_weight) and m.fail[0] == 0 and (m.fail[1:] < np.arange(1, len(m.fail))).all()
    state, weight = np.zeros(1, np.int64), []
    for symbol in stream.symbol[stream.first[3]:stream.first[4]]:  # start a c end: "a c" was never seen
        state, w = m.step(state, np.array([symbol]))
        weight.append(float(w[0]))
    p = {"a": 2.5 / 10.5, "b": 2.5 / 10.5, "c": 1.5 / 10.5, "end": 3.5 / 10.5}
    start_a = (2 + 2 * p["a"]) / 5  # three starts, two of them before a
    a_c = 2 / 4 * p["c"]  # a twice; "start a" twice as well
    assert weight[1:3] == pytest.approx([math.log10(start_a), math.log10(2 / 4 * a_c)])
    assert weight[3] == pytest.approx(math.log10((1 + 2 * p["end"]) / 3))  # "c end" after a failure to c


def test_edit_distance_span():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    b = np.array([9, 1, 2, 7, 4, 5, 9], np.uint64)
    assert decontaminate.edit_distance(a, b) == (1, 1, 6)
    assert decontaminate.edit_distance(a, b[:0]) == (5, 0, 0)


def test_leak_edge_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, f"x {item.upper()} y"), (1, f"x {item.upper()} y"), (2, None), (3, ""), (4, "alpha " * 5000), (None, item), (5, "one two"), (6, item.replace(" ", "&&& ")), (7, item[:30])]
    bench = [(10, item), (11, None), (12, ""), (13, "one two"), (None, item)]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash"))
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(df, spark.createDataFrame(bench, "item_id long, text string")).collect()), key=str)
    want = [(d, i, 0) for d in (1, 1, None, 6) for i in (10, -1)] + [(5, 13, 0)]
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame([], DOCS)
    assert decontaminate.find_leaks(empty, spark.createDataFrame(bench, "item_id long, text string")).collect() == []
    assert decontaminate.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).collect() == []
