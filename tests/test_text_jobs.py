"""Text jobs, tokenizers and block-aware page text."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.text import block_text
from pairlab.functions.tokenizers import SubwordTokenizer
from pairlab.operators import prepare as pp
from pairlab.operators import reshape as rs
from pairlab.operators import retrieve as rt
from pairlab.operators import texts


def test_repeated_texts_are_transformed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def upper(batch):
        calls.add(len(batch))
        return [t.upper() for t in batch]

    rows = [(i, "hot text" if i % 3 == 0 else f"t{i % 7}", "x") for i in range(900)] + [(900, None, "x"), (901, "", "x"), (902, "SAME", "x")]
    df = spark.createDataFrame(rows, "id long, text string, result string").repartition(6)
    job = texts.transform_texts(df, "text", upper)
    assert job.rows.columns == ["id", "text", "result"]
    assert {r.id: r.text for r in job.rows.collect()} == {i: t.upper() if t is not None else None for i, t, _ in rows}
    assert calls.value == len({t for _, t, _ in rows if t is not None})
    r = job.report().first()
    assert (r.n_rows, r.n_null_rows, r.n_texts, r.n_changed_texts, r.n_changed_rows) == (903, 1, 10, 8, 900)


def test_failures_are_counted_and_do_not_spread(spark):
    def strict(batch):
        if any("bad" in t for t in batch):
            raise ValueError("bad")
        return [len(t) for t in batch]

    df = spark.createDataFrame([("a",), ("bad",), ("bad",), ("ccc",), (None,)], "t string")
    job = texts.transform_texts(df, "t", strict, out="n", to=T.LongType())
    assert sorted(job.rows.collect(), key=str) == sorted([("a", 1), ("bad", None), ("bad", None), ("ccc", 3), (None, None)], key=str)
    r = job.report().first()
    assert (r.n_failed_rows, r.n_failed_texts, r.n_changed_rows) == (2, 1, 0)


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "t string")
    job = texts.transform_texts(empty, "t", lambda b: b)
    assert job.rows.count() == 0 and job.report().first().n_rows == 0
    long = spark.createDataFrame([("int main() { " + "x" * 2_000_000 + " } tail",)], "code string")
    assert texts.first_programs(long).rows.first().code.endswith("x }")


def test_list_job_sends_only_what_is_no_json(spark):
    df = spark.createDataFrame([("['a', 'b']", 1), ("[None, 2]", 2), ("[oops", 3), ("[oops]", 4), ("plain", 5), (None, 6)], "a string, _json int")
    out, reports = rs.parse_list_job(df.select("a"), ["a"])
    got = [r.a for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [["a", "b"], [None, "2"], ["[oops"], None, ["plain"], None]))
    r = reports["a"].first()
    assert (r.n_texts, r.n_failed_texts) == (2, 1)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_tokenizer_files(spark, name):
    public = pytest.importorskip("public_tokenizers")
    bpe = SubwordTokenizer(public.path(name))
    words = ["int main() { return 0; }", "größer  als\n<|endoftext|> 1", "", "same", "same"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*words, None])], "id int, text string")
    got = {r.id: r.ids for r in texts.encode_ids(df, "text", bpe, out="ids").rows.collect()}
    assert got == {**{i: bpe.encode([t])[0] for i, t in enumerate(words)}, 5: None}
    counts = {r.id: r.n_tokens for r in texts.count_tokens(df, "text", bpe).rows.collect()}
    assert counts == {i: len(x or []) for i, x in got.items()}
    if name.startswith("byte"):
        assert bpe.decode(bpe.encode(words)) == words
    with pytest.raises(ValueError):
        SubwordTokenizer("vocabulary.txt")


def test_two_readers_of_one_vocabulary_agree():
    public = pytest.importorskip("public_tokenizers")
    a, b = (SubwordTokenizer(public.path(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken"))
    text = ["for (int i = 0; i < n; ++i)\n\tx[i] += 1.5e-3;  // größe"]
    assert a.encode(text) == b.encode(text)


def test_labels_element_by_element(spark):
    public = pytest.importorskip("public_tokenizers")
    bpe = SubwordTokenizer(public.path("byte_bpe_50k.json"))
    rows = [(1, "a program and its target", "a program"), (2, "x" * 400, "x"), (3, None, None), (4, "", "")]
    df = spark.createDataFrame(rows, "id int, full_prompt string, user_prompt string")
    eos, cutoff = 50256, 12
    for r in pp.tokenize_and_mask(df, cutoff=cutoff, tokenizer=bpe, eos_id=eos).collect():
        full, user = ((bpe(t) if t else [])[:cutoff] for t in (r.full_prompt, r.user_prompt))
        full, user = ([*x, eos] if len(x) < cutoff else x for x in (full, user))
        n = max(len(user) - 1, 0)
        assert r.input_ids == full and r.attention_mask == [1] * len(full) and r.labels == [-100] * n + full[n:]
    whole = pp.tokenize_and_mask(df, cutoff=cutoff, tokenizer=bpe, train_on_inputs=True).collect()
    assert all(r.labels == r.input_ids for r in whole) and set(whole[0].asDict()) == {"id", "full_prompt", "user_prompt", "input_ids", "attention_mask", "labels"}


def test_md5_ids_follow_their_rule(spark):
    import hashlib
    got = spark.createDataFrame([("a b a",)], "t string").select(pp.md5_token_ids(F.col("t")).alias("x")).first().x
    want = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 31997 + 3 for t in "aba"]
    assert got == want


@pytest.mark.parametrize("html,want", [
    ("<p>one two</p><p>three</p>", "one two\n\nthree"),
    ("<div><p>in</p>out</div>", "in\n\nout"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<ul><li>x</li><li><b>y</b> z</li></ul>end", "x\ny z\n\nend"),
    ("<table><tr><th>h</th><td>1</td></tr><tr><td>2</td></tr></table>", "h 1\n2"),
    ("x <a name='q'></a><a href='u'>link</a><img alt='no'> y", "x link y"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("<head><title>t</title></head><script>if (a<b) {}</script><style>p</style>&lt;tag&gt; &amp; &eacute;", "<tag> & é"),
    ("  \n <p> \n </p> lone ", "lone"),
    ("<p>open <p>again", "open\n\nagain"),
    ("", ""),
])
def test_block_text(html, want):
    assert block_text(html, fallback=0) == want


def test_block_text_falls_back_to_the_page():
    assert block_text("<b>short</b>") == "<b>short</b>" and block_text(None) is None


def test_encoders(spark):
    calls = spark.sparkContext.accumulator(0)

    def encoder(batch):
        calls.add(len(batch))
        return [[float(len(t)), 1.0] for t in batch]

    df = spark.createDataFrame([(i, ["ab", "abc", None][i % 3]) for i in range(30)], "id int, t string")
    got = {r.id: r.embedding for r in rt.encode_text(df, "t", encoder=encoder).collect()}
    assert calls.value == 2 and got[0] == [2.0, 1.0] and got[1] == [3.0, 1.0] and got[2] is None
    grams = {r.id: r.embedding for r in rt.encode_text(df, "t", method="ngrams").collect()}
    assert grams[2] is None and grams[0] == [0.0] * 64 and sum(map(abs, grams[1])) == 1.0
