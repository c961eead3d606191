import pytest
from pyspark.sql import functions as F

from pairlab.functions.text import cut_after_main, extract_response, html_to_text
from pairlab.operators import prepare as pp


def frame(spark, desc=None, bin_=None, pct=None):
    return spark.createDataFrame([("SRC", "TGT", desc, bin_, pct)],
                                 "src_code string, tgt_code string, d string, b string, p string")


def prompt(spark, template, **kw):
    df = frame(spark, kw.pop("desc", None), kw.pop("bin_", None), kw.pop("pct", None))
    return pp.training_prompt(df, template, speedup_desc="d", speedup_bin="b", pctile="p", **kw).first()["prompt"]


def test_precedence_and_fill(spark):
    assert prompt(spark, "code_opt_w_speedup_desc", desc="faster", pct="3").startswith(
        "Below is a program. Optimize the program and provide a faster version.")
    p = prompt(spark, "code_opt_w_speedup_pctile", pct="3")
    assert p == ("This is a slow program we want to optimize 3/10. ### Program:\nSRC\n\n"
                 "### Optimized Version with score 3/10:\nTGT")
    p = prompt(spark, "code_opt_w_speedup_pctile", pct="", pctile_test=True, target=False)
    assert "optimize 10/10" in p and not p.endswith("TGT")
    assert prompt(spark, "code_opt", desc="", target=False).endswith("### Optimized Version:\n")


def test_desc_and_bin_together_raise(spark):
    with pytest.raises(Exception):
        prompt(spark, "code_opt_w_speedup_desc", desc="x", bin_="y")


def test_missing_slot_raises(spark):
    with pytest.raises(Exception):
        prompt(spark, "code_opt_w_speedup_pctile")


def test_slot_values_are_not_expanded_again(spark):
    df = spark.createDataFrame([("{pctile}", None, "7")], "src_code string, tgt_code string, p string")
    p = pp.training_prompt(df, "code_opt_w_speedup_pctile", pctile="p").first()["prompt"]
    assert "Program:\n{pctile}\n" in p


def test_cutoff_in_characters(spark):
    df = spark.createDataFrame([("x" * 2000, "y" * 2000)], "src_code string, tgt_code string")
    p = pp.training_prompt(df, "code_opt").first()["prompt"]
    assert p.count("x") == 1500 and p.count("y") == 1500


def test_extract_response(spark):
    df = spark.createDataFrame([("a ### Optimized Version:\n  B \n",), ("none",)], "t string")
    got = [r[0] for r in df.select(extract_response(F.col("t"), "### Optimized Version:")).collect()]
    assert got == ["B", None]


@pytest.mark.parametrize("text,want", [
    ("int main() { if (x) { y; } return 0; }\nint main() {}", "int main() { if (x) { y; } return 0; }"),
    ("no entry point { }", "no entry point { }"),
    ("int main() { {", "int main() { {"),
    ('int main() { puts("}"); }', 'int main() { puts("}'),
])
def test_first_program(text, want):
    assert cut_after_main(text) == want


def test_html_parser_form(spark):
    df = spark.createDataFrame([("<html><script>var a='<p>';</script><p>Hello &amp; welcome to this problem text!</p></html>",),
                                ("<b>hi</b>",)], "h string")
    got = [r[0] for r in df.select(html_to_text(F.col("h"))).collect()]
    assert got == ["Hello & welcome to this problem text!", "<b>hi</b>"]


def test_tokens_mask(spark):
    df = spark.createDataFrame([("a b c d", "a b")], "full_prompt string, user_prompt string")
    r = pp.tokenize_and_mask(df, cutoff=16).first()
    assert r["input_ids"][-1] == 2 and len(r["input_ids"]) == 5
    assert r["labels"][:2] == [-100, -100] and r["labels"][2:] == r["input_ids"][2:]
    assert r["attention_mask"] == [1] * 5
    r = pp.tokenize_and_mask(df, cutoff=4).first()
    assert len(r["input_ids"]) == 4 and r["input_ids"][-1] != 2


def test_shuffle_head_is_a_permutation(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert sorted(r["k"] for r in pp.shuffle_head(df, -1, key="k", seed=5).collect()) == list(range(100))
    assert pp.shuffle_head(df, 10, key="k", seed=5).count() == 10


def test_chat_examples(spark):
    df = spark.createDataFrame([("S", "TTTT")], "src_code string, tgt_code string")
    r = pp.chat_examples(df, max_len=2).first()
    assert [m["role"] for m in r["messages"]] == ["system", "user", "assistant"]
    assert r["messages"][1]["content"] == "// slower version::\n\nS\n\n// optimized version of the same code:\n\n"
    assert r["messages"][2]["content"] == "TT"


def test_ntile_tag_equals_window_ntile(spark):
    from pyspark.sql import Window
    rows = [(g, i, float((i * 7) % 13)) for g, n in ((1, 3), (2, 10), (3, 23), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "problem_id long, submission_id long, agg_runtime double")
    got = {r["submission_id"] + 1000 * r["problem_id"]: r["pctile"]
           for r in pp.performance_tag(df, method="ntile", order_key="submission_id").collect()}
    w = Window.partitionBy("problem_id").orderBy(F.col("agg_runtime").desc(), "submission_id")
    want = {r["k"]: str(r["t"]) for r in df.select((F.col("submission_id") + 1000 * F.col("problem_id")).alias("k"),
                                                   F.ntile(10).over(w).alias("t")).collect()}
    assert got == want


def test_postprocess_only_for_code_opt(spark):
    from pairlab.functions.text import postprocess_completion
    df = spark.createDataFrame([("int main() { a; }\nint main() { b; }",)], "t string")
    cut = df.select(postprocess_completion(F.col("t"), "code_opt")).first()[0]
    kept = df.select(postprocess_completion(F.col("t"), "code_opt_w_speedup_desc")).first()[0]
    assert cut == "int main() { a; }" and kept.endswith("b; }")


def test_pivot_base_row_and_value_types(spark):
    from pairlab.operators.reshape import pivot_results
    df = spark.createDataFrame([(1, "src_code", "S", 1.0, "p1"), (1, "gen_0", "G", 0.5, "p1")],
                               "src_id long, code_type string, code string, rt double, problem_id string")
    w = pivot_results(df, key="src_id", types=["src_code", "gen_0"], values=["rt"],
                      base_type="src_code", base_cols=["problem_id"], value_types=["gen_0"]).first()
    assert w["gen_0_rt"] == 0.5 and w["problem_id"] == "p1" and "src_code_rt" not in w.asDict()
