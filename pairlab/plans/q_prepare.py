"""Checked queries for PREP, reshape, set operations and sources/sinks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.functions.text import extract_response, seeded_hash_sql
from pairlab.functions.tokenizers import SubwordTokenizer
from pairlab.operators import augment as au
from pairlab.operators import prepare as pp
from pairlab.operators import reshape as rs
from pairlab.operators import texts
from pairlab.plans.fixtures import oracle_with, table, view
from pairlab.plans.registry import fin, query, sql_str, template_sql
from pairlab.session import checkpoint_dir
from pairlab.sources import io

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip_sql(x: str) -> str:
    return _STRIP.format(x=x)


# ---- PREP --------------------------------------------------------------------

@query("w8_performance_tag", oracle_with(["v_submissions"], """
, acc AS (SELECT submission_id, problem_id, agg_runtime FROM v_submissions
          WHERE status = 'Accepted' AND agg_runtime IS NOT NULL AND isfinite(agg_runtime))
, b AS (SELECT problem_id, min(agg_runtime) AS best FROM acc GROUP BY problem_id)
SELECT submission_id, problem_id,
  CAST(CAST(greatest(1, ceil(CAST(10.0 AS DOUBLE) * (best / agg_runtime))) AS BIGINT) AS VARCHAR) AS pctile
FROM acc JOIN b USING (problem_id)"""))
def w8_performance_tag(spark, sf):
    subs = au.accepted_finite(view(spark, sf, "v_submissions"))
    return pp.performance_tag(subs).select("submission_id", "problem_id", "pctile")


@query("w8_performance_tag_ntile", oracle_with(["v_submissions"], """
, acc AS (SELECT submission_id, problem_id, agg_runtime FROM v_submissions
          WHERE status = 'Accepted' AND agg_runtime IS NOT NULL AND isfinite(agg_runtime))
SELECT submission_id, problem_id,
  CAST(ntile(10) OVER (PARTITION BY problem_id ORDER BY agg_runtime DESC, submission_id) AS VARCHAR) AS pctile
FROM acc"""))
def w8_performance_tag_ntile(spark, sf):
    subs = au.accepted_finite(view(spark, sf, "v_submissions"))
    return pp.performance_tag(subs, method="ntile", order_key="submission_id").select(
        "submission_id", "problem_id", "pctile")


@query("w8_performance_tag_ntile_payload", oracle_with(["v_submissions"], """
, acc AS (SELECT * FROM v_submissions WHERE status = 'Accepted' AND agg_runtime IS NOT NULL AND isfinite(agg_runtime))
SELECT submission_id, problem_id, src_id, CAST(gen_idx AS BIGINT) AS gen_idx,
  CAST(ntile(10) OVER (PARTITION BY problem_id ORDER BY agg_runtime DESC, submission_id) AS VARCHAR) AS pctile FROM acc"""))
def w8_performance_tag_ntile_payload(spark, sf):
    """The same tag with columns that are no part of the order."""
    subs = au.accepted_finite(view(spark, sf, "v_submissions"))
    return pp.performance_tag(subs, method="ntile", order_key="submission_id").select("submission_id", "problem_id", "src_id", "gen_idx", "pctile")


@query("o2_shuffle_head_string_ids", f"""
SELECT 'p' || doc_id AS doc_id FROM documents ORDER BY {seeded_hash_sql("'p' || doc_id", seed=7)}, 1 LIMIT 50""")
def o2_shuffle_head_string_ids(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("doc_id"))
    return pp.shuffle_head(d, 50, key="doc_id", seed=7)


_PAIRS_TAGGED = """
, pt AS (SELECT *, CAST(length(tgt_code) AS DOUBLE) AS rt FROM v_pairs)
, pb AS (SELECT problem_id, min(rt) AS best FROM pt GROUP BY problem_id)
, tagged AS (SELECT pt.*, CAST(CAST(greatest(1, ceil(CAST(10.0 AS DOUBLE) * (best / rt))) AS BIGINT) AS VARCHAR) AS pctile
             FROM pt JOIN pb USING (problem_id))
"""


def _tagged_pairs(spark, sf):
    p = view(spark, sf, "v_pairs").withColumn("rt", F.length("tgt_code").cast("double"))
    return pp.performance_tag(p, runtime="rt")


def _prompt_sql(template: str, slot_sql: dict[str, str], src: str = "src_code") -> str:
    return template_sql(template, {"src_code": f"substr({src}, 1, 1500)", **slot_sql})


_PCT = pp.TEMPLATES["code_opt_w_speedup_pctile"][0]
_PLAIN = pp.TEMPLATES["code_opt"][0]


@query("f7_training_prompt", oracle_with(["v_pairs"], _PAIRS_TAGGED + f"""
, x AS (SELECT src_id, {_prompt_sql(_PCT, {'pctile': 'pctile'})} ||
          CASE WHEN tgt_code IS NOT NULL AND tgt_code <> '' THEN substr(tgt_code, 1, 1500) ELSE '' END AS prompt
        FROM tagged)
SELECT src_id, CAST(length(prompt) AS BIGINT) AS prompt_length, sha256(prompt) AS prompt_hash FROM x"""))
def f7_training_prompt(spark, sf):
    d = pp.training_prompt(_tagged_pairs(spark, sf), "code_opt_w_speedup_pctile", pctile="pctile")
    return d.select("src_id", F.length("prompt").alias("prompt_length"), F.sha2("prompt", 256).alias("prompt_hash"))


_MARK = pp.TEMPLATES["code_opt"][1]


@query("f8_extract_response", oracle_with(["v_pairs"], f"""
, x AS (SELECT src_id, {_prompt_sql(_PLAIN, {})} ||
          CASE WHEN tgt_code IS NOT NULL AND tgt_code <> '' THEN substr(tgt_code, 1, 1500) ELSE '' END AS prompt
        FROM v_pairs)
, y AS (SELECT src_id, CASE WHEN strpos(prompt, '{_MARK}') > 0 THEN
          {strip_sql(f"substr(prompt, strpos(prompt, '{_MARK}') + {len(_MARK)})")} END AS response FROM x)
SELECT src_id, sha256(response) AS response_hash FROM y"""))
def f8_extract_response(spark, sf):
    d = pp.training_prompt(view(spark, sf, "v_pairs"), "code_opt")
    return d.select("src_id", F.sha2(extract_response(F.col("prompt"), _MARK), 256).alias("response_hash"))


# completions with programs: balanced, nested, unclosed, with stray braces, and without main
_PROGRAMS = """
, prog AS (SELECT src_id, CASE src_id % 5
    WHEN 0 THEN 'int main() { ' || tgt_code || ' } trailing { ' || tgt_code || ' }'
    WHEN 1 THEN tgt_code || ' struct s { int a; }; int  main(int c) { if (c) { x(); } else { y(); } } int f() { }'
    WHEN 2 THEN 'void main { { ' || tgt_code
    WHEN 3 THEN 'main } } { a } { b } ' || tgt_code
    ELSE tgt_code END AS code FROM v_pairs)
"""


def _programs(spark, sf):
    t, k = F.col("tgt_code"), F.col("src_id") % 5
    code = (F.when(k == 0, F.concat(F.lit("int main() { "), t, F.lit(" } trailing { "), t, F.lit(" }")))
            .when(k == 1, F.concat(t, F.lit(" struct s { int a; }; int  main(int c) { if (c) { x(); } else { y(); } } int f() { }")))
            .when(k == 2, F.concat(F.lit("void main { { "), t))
            .when(k == 3, F.concat(F.lit("main } } { a } { b } "), t)).otherwise(t))
    return view(spark, sf, "v_pairs").select("src_id", code.alias("code"))


_FIRST = _PROGRAMS + r"""
, m AS (SELECT src_id, code, regexp_extract(code, '\b(?:int\s+)?main\b') AS hit FROM prog)
, tail AS (SELECT src_id, code, CASE WHEN hit <> '' THEN strpos(code, hit) + length(hit) - 1 END AS cut FROM m)
, ch AS (SELECT src_id, cut, i, substr(code, cut + i, 1) AS c FROM tail, unnest(range(1, length(code) - cut + 1)) AS u(i) WHERE cut IS NOT NULL)
, st AS (SELECT src_id, cut, i, c, sum(CASE c WHEN '{' THEN 1 ELSE -1 END) OVER w AS depth, max(CASE c WHEN '{' THEN 1 ELSE 0 END) OVER w AS opened
         FROM ch WHERE c IN ('{', '}') WINDOW w AS (PARTITION BY src_id ORDER BY i))
, e AS (SELECT src_id, min(cut + i) AS stop FROM st WHERE c = '}' AND depth = 0 AND opened = 1 GROUP BY src_id)
, kept AS (SELECT prog.src_id, code, CASE WHEN stop IS NULL THEN code ELSE substr(code, 1, stop) END AS kept FROM prog LEFT JOIN e USING (src_id))
"""


@query("f9_first_program", oracle_with(["v_pairs"], _FIRST + """
SELECT src_id, sha256(kept) AS kept_hash, length(kept) < length(code) AS was_cut FROM kept"""))
def f9_first_program(spark, sf):
    d = texts.first_programs(_programs(spark, sf), "code", out="kept").rows
    return d.select("src_id", F.sha2("kept", 256).alias("kept_hash"), (F.length("kept") < F.length("code")).alias("was_cut"))


_REPORT = """CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE t IS NULL) AS BIGINT) AS n_null_rows, CAST(count(DISTINCT t) AS BIGINT) AS n_texts,
  CAST(count(*) FILTER (WHERE NOT bad AND r <> t) AS BIGINT) AS n_changed_rows, CAST(count(DISTINCT CASE WHEN NOT bad AND r <> t THEN t END) AS BIGINT) AS n_changed_texts,
  CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS n_failed_rows, CAST(count(DISTINCT CASE WHEN bad THEN t END) AS BIGINT) AS n_failed_texts"""


@query("f9_first_program_report", oracle_with(["v_pairs"], _FIRST + f"""
, three AS (SELECT code AS t, kept AS r, false AS bad FROM kept UNION ALL SELECT code, kept, false FROM kept
            UNION ALL SELECT CASE WHEN src_id % 2 = 0 THEN 'int main() {{ }} x' END, CASE WHEN src_id % 2 = 0 THEN 'int main() {{ }}' END, false FROM kept)
SELECT {_REPORT} FROM three"""))
def f9_first_program_report(spark, sf):
    """Every program twice, one program in a sixth of all rows, and nulls: what the job did."""
    d = _programs(spark, sf)
    hot = d.select("src_id", F.when(F.col("src_id") % 2 == 0, F.lit("int main() { } x")).alias("code"))
    return texts.first_programs(d.unionByName(d).unionByName(hot)).report()


@query("p4_parse_list_report", oracle_with(["v_pairs"], f"""
, l AS (SELECT CASE src_id % 4 WHEN 0 THEN '[None, ' || src_id % 7 || ']' WHEN 1 THEN '[broken ' || src_id || ']' END AS t, src_id % 4 = 1 AS bad FROM v_pairs)
, x AS (SELECT t, t AS r, bad FROM l)
SELECT {_REPORT} FROM x"""))
def p4_parse_list_report(spark, sf):
    """Lists that are no JSON: some are Python literals, some nothing; the rest never reaches Python."""
    k = F.col("src_id") % 4
    text = (F.when(k == 0, F.concat(F.lit("[None, "), (F.col("src_id") % 7).cast("string"), F.lit("]")))
            .when(k == 1, F.concat(F.lit("[broken "), F.col("src_id").cast("string"), F.lit("]")))
            .when(k == 2, F.lit("['a', 'b']")).otherwise(F.col("tgt_code")))
    return rs.parse_list_job(view(spark, sf, "v_pairs").select("src_id", text.alias("a")), ["a"])[1]["a"]


@query("f10_chat_examples", oracle_with(["v_pairs"], f"""
SELECT src_id, {sql_str(pp.CHAT_SYSTEM)} AS system_content,
  sha256({template_sql(pp.CHAT_USER_TEMPLATE, {'src_code': 'src_code'})}) AS user_hash,
  CAST(length(tgt_code) AS BIGINT) AS assistant_length, CAST(3 AS BIGINT) AS n_messages FROM v_pairs"""))
def f10_chat_examples(spark, sf):
    d = pp.chat_examples(view(spark, sf, "v_pairs"))
    m = F.col("messages")
    return d.select("src_id", m[0]["content"].alias("system_content"),
                    F.sha2(m[1]["content"], 256).alias("user_hash"),
                    F.length(m[2]["content"]).alias("assistant_length"), F.size(m).alias("n_messages"))


_FULL = _prompt_sql(_PLAIN, {}) + " || CASE WHEN tgt_code IS NOT NULL AND tgt_code <> '' THEN substr(tgt_code, 1, 1500) ELSE '' END"


def _f11_sql() -> str:
    from pairlab.plans.q_augment import ntok
    return oracle_with(["v_pairs"], f"""
, x AS (SELECT src_id, {_FULL} AS fp, {_prompt_sql(_PLAIN, {})} AS up FROM v_pairs)
, y AS (SELECT src_id, {ntok('fp')} AS tf, {ntok('up')} AS tu FROM x)
, z AS (SELECT src_id, CASE WHEN tf < 256 THEN tf + 1 ELSE 256 END AS n_ids,
          greatest(CASE WHEN tu < 256 THEN tu + 1 ELSE 256 END - 1, 0) AS n FROM y)
SELECT src_id, CAST(n_ids AS BIGINT) AS n_ids, CAST(n AS BIGINT) AS n_masked,
  CAST(n + greatest(n_ids - n, 0) AS BIGINT) AS n_labels FROM z""")


@query("f11_tokenize_and_mask", _f11_sql())
def f11_tokenize_and_mask(spark, sf):
    d = pp.build_training_set(view(spark, sf, "v_pairs"), form="tokens", seed=1, cutoff=256)
    return d.select("src_id", F.size("input_ids").alias("n_ids"),
                    F.size(F.filter("labels", lambda x: x == -100)).alias("n_masked"),
                    F.size("labels").alias("n_labels"))


def _f11_ids_sql(cutoff: int) -> str:
    from pairlab.plans.q_augment import TOKEN_SQL

    def ids(x: str) -> str:
        return f"list_transform(regexp_extract_all({x}, '{TOKEN_SQL}'), lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 31997 + 3)[1:{cutoff}]"

    def end(x: str) -> str:
        return f"CASE WHEN len({x}) < {cutoff} THEN list_append({x}, CAST(2 AS BIGINT)) ELSE {x} END"

    def text(x: str) -> str:
        return f"sha256(array_to_string({x}, ','))"
    return oracle_with(["v_pairs"], f"""
, x AS (SELECT src_id, {ids('(' + _FULL + ')')} AS f, {ids('(' + _prompt_sql(_PLAIN, {}) + ')')} AS u FROM v_pairs)
, y AS (SELECT src_id, {end('f')} AS f, len({end('u')}) - 1 AS n FROM x)
, z AS (SELECT src_id, f, list_concat(list_transform(range(n), lambda i: CAST(-100 AS BIGINT)), f[n + 1:]) AS l FROM y)
SELECT src_id, CAST(len(f) AS BIGINT) AS n_ids, {text('f')} AS ids_hash, {text('list_transform(f, lambda i: 1)')} AS attention_hash, {text('l')} AS labels_hash FROM z""")


def _joined(c: str):
    return F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)


@query("f11_tokenize_and_mask_ids", _f11_ids_sql(256))
def f11_tokenize_and_mask_ids(spark, sf):
    """Ids, attention and labels of every pair, element by element."""
    d = pp.build_training_set(view(spark, sf, "v_pairs"), form="tokens", seed=1, cutoff=256, token_ids=pp.md5_token_ids)
    return d.select("src_id", F.size("input_ids").alias("n_ids"), _joined("input_ids").alias("ids_hash"), _joined("attention_mask").alias("attention_hash"),
                    _joined("labels").alias("labels_hash"))


def vocabulary(name: str) -> SubwordTokenizer:
    """A public vocabulary of this machine, by the name of its file."""
    import public_tokenizers
    return SubwordTokenizer(public_tokenizers.path(name))


@query("f11_tokenize_and_mask_bpe", oracle_with(["v_pairs"], f"""
, x AS (SELECT src_id, {_FULL} AS fp FROM v_pairs)
SELECT src_id, sha256(fp) AS text_hash, true AS ends_with_eos, true AS all_attended, true AS labels_follow FROM x"""))
def f11_tokenize_and_mask_bpe(spark, sf):
    """A byte-level subword vocabulary: the ids of every prompt, taken back to text."""
    bpe, eos = vocabulary("byte_bpe_50k.json"), 50256
    d = pp.build_training_set(view(spark, sf, "v_pairs"), form="tokens", seed=1, cutoff=1 << 20, tokenizer=bpe, eos_id=eos)
    n = F.size("input_ids")
    follow = F.zip_with("labels", "input_ids", lambda label, i: (label == i) | (label == -100))
    out = d.select("src_id", F.slice("input_ids", 1, n - 1).alias("ids"), (F.element_at("input_ids", -1) == eos).alias("ends_with_eos"),
                   (F.size(F.filter("attention_mask", lambda x: x == 1)) == n).alias("all_attended"), F.forall(follow, lambda x: x).alias("labels_follow"))
    back = texts.decode_ids(out, "ids", bpe, out="text")
    return back.select("src_id", F.sha2("text", 256).alias("text_hash"), "ends_with_eos", "all_attended", "labels_follow")


@query("f3_token_length_bpe")
def f3_token_length_bpe(spark, sf):
    """Subword tokens of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return texts.count_tokens(docs, "text", vocabulary("byte_bpe_50k.json")).rows.select("doc_id", "n_tokens")


@query("f3_token_round_trip", """
SELECT vocabulary, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE text IS NULL) AS BIGINT) AS n_null_rows, CAST(count(DISTINCT text) AS BIGINT) AS n_texts,
  CAST(0 AS BIGINT) AS n_changed_rows, CAST(0 AS BIGINT) AS n_changed_texts, CAST(0 AS BIGINT) AS n_failed_rows, CAST(0 AS BIGINT) AS n_failed_texts
FROM documents, (VALUES ('byte_bpe_50k.json'), ('byte_bpe_50k.tiktoken')) AS v(vocabulary) GROUP BY vocabulary""")
def f3_token_round_trip(spark, sf):
    """Every document to ids and back by two readers of a byte-level vocabulary: no text is changed."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    reports = []
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        bpe = vocabulary(name)
        reports.append(texts.transform_texts(docs, "text", lambda t, bpe=bpe: bpe.decode(bpe.encode(t))).report().withColumn("vocabulary", F.lit(name)))
    return reports[0].unionByName(reports[1])


@query("o2_shuffle_head", f"""
SELECT doc_id FROM documents ORDER BY {seeded_hash_sql('doc_id', seed=42)}, doc_id LIMIT 50""")
def o2_shuffle_head(spark, sf):
    return pp.shuffle_head(table(spark, sf, "documents"), 50, key="doc_id", seed=42).select("doc_id")


@query("o1_first_n", oracle_with(["v_pairs"], """
SELECT src_id, CAST(problem_id AS BIGINT) AS problem_id FROM v_pairs ORDER BY src_id LIMIT 100"""))
def o1_first_n(spark, sf):
    return pp.first_n(view(spark, sf, "v_pairs"), 100, ordinal="src_id").select("src_id", "problem_id")


@query("a19_latest_metrics", f"""
SELECT user_id AS file, event_id AS step, event_type, {fin('value')} AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def a19_latest_metrics(spark, sf):
    m = table(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("step"),
                                          "event_type", "value")
    return pp.latest_metrics(m)


# ---- reshape -----------------------------------------------------------------

@query("p2_clean_code_rows", oracle_with(["v_generations"], """
SELECT src_id, CAST(gen_idx AS BIGINT) AS gen_idx, code FROM v_generations WHERE code IS NOT NULL AND length(code) > 0"""))
def p2_clean_code_rows(spark, sf):
    return rs.clean_code_rows(view(spark, sf, "v_generations")).select("src_id", "gen_idx", "code")


def _answer_lists(spark, sf):
    g = view(spark, sf, "v_generations")
    lit = F.coalesce(F.concat(F.lit("'"), F.col("code"), F.lit("'")), F.lit("None"))
    per = g.groupBy("src_id").agg(F.sort_array(F.collect_list(F.struct("gen_idx", lit.alias("v"), "code"))).alias("_l"))
    return per.select("src_id",
                      F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x["v"]), ", "), F.lit("]"))
                      .alias("generated_answers"),
                      F.transform("_l", lambda x: x["code"]).alias("answers"))


@query("p4_parse_list_literal", oracle_with(["v_generations"], """
SELECT src_id, CAST(count(*) AS BIGINT) AS n_items,
  string_agg(coalesce(code, '<null>'), ',' ORDER BY gen_idx) AS items FROM v_generations GROUP BY src_id"""))
def p4_parse_list_literal(spark, sf):
    d = rs.parse_list_literal(_answer_lists(spark, sf).select("src_id", "generated_answers"), ["generated_answers"])
    a = F.col("generated_answers")
    return d.select("src_id", F.size(a).alias("n_items"),
                    F.array_join(F.transform(a, lambda x: F.coalesce(x, F.lit("<null>"))), ",").alias("items"))


@query("p4_parse_list_literal_plain", oracle_with(["v_generations"], """
SELECT src_id, CAST(gen_idx AS BIGINT) AS gen_idx, CAST(CASE WHEN code IS NOT NULL THEN 1 END AS BIGINT) AS n_items, code AS first_item FROM v_generations"""))
def p4_parse_list_literal_plain(spark, sf):
    """Single answers, not written as lists."""
    d = rs.parse_list_literal(view(spark, sf, "v_generations").select("src_id", "gen_idx", "code"), ["code"])
    return d.select("src_id", "gen_idx", F.when(F.col("code").isNotNull(), F.size("code")).alias("n_items"), F.get("code", F.lit(0)).alias("first_item"))


@query("p5_explode_generations", oracle_with(["v_generations"], """
SELECT src_id, CAST(gen_idx AS BIGINT) AS gen_idx, code FROM v_generations"""))
def p5_explode_generations(spark, sf):
    return rs.explode_generations(_answer_lists(spark, sf), "answers", keys=["src_id"])


_LONG = """
, long AS (SELECT src_id, 'src_code' AS code_type, src_code AS code FROM v_pairs
           UNION ALL SELECT src_id, 'tgt_code', tgt_code FROM v_pairs)
"""


def _long(spark, sf):
    return rs.unpivot_code(view(spark, sf, "v_pairs").select("src_id", "src_code", "tgt_code"),
                           ["src_id"], ["src_code", "tgt_code"])


@query("p6_unpivot_code", oracle_with(["v_pairs"], _LONG + """
SELECT src_id, code_type, sha256(code) AS code_hash FROM long"""))
def p6_unpivot_code(spark, sf):
    return _long(spark, sf).select("src_id", "code_type", F.sha2("code", 256).alias("code_hash"))


def _wide(spark, sf):
    long = _long(spark, sf).withColumn("len", F.length("code")).withColumn("hash", F.sha2("code", 256))
    return rs.pivot_results(long, key="src_id", types=["src_code", "tgt_code"], values=["len", "hash"])


@query("p7_pivot_results", oracle_with(["v_pairs"], """
SELECT src_id, CAST(length(src_code) AS BIGINT) AS src_code_len, sha256(src_code) AS src_code_hash,
  CAST(length(tgt_code) AS BIGINT) AS tgt_code_len, sha256(tgt_code) AS tgt_code_hash FROM v_pairs"""))
def p7_pivot_results(spark, sf):
    return _wide(spark, sf)


@query("p7_pivot_results_base", oracle_with(["v_pairs"], """
SELECT src_id, CAST(length(tgt_code) AS BIGINT) + CASE WHEN src_id % 3 = 0 THEN 1000 ELSE 0 END AS tgt_code_len,
  CAST(length(src_code) AS BIGINT) AS base_len, CAST(0 AS BIGINT) AS seq FROM v_pairs"""))
def p7_pivot_results_base(spark, sf):
    """Some rows were measured twice: the last measurement counts, the base row is the first."""
    once = _long(spark, sf).withColumn("len", F.length("code").cast("bigint")).withColumn("seq", F.lit(0))
    again = once.filter("src_id % 3 = 0").withColumn("len", F.col("len") + 1000).withColumn("seq", F.lit(1))
    both = again.unionByName(once).withColumn("base_len", F.col("len"))
    return rs.pivot_results(both, key="src_id", types=["src_code", "tgt_code"], values=["len"], order="seq", base_type="src_code",
                            base_cols=["base_len", "seq"], value_types=["tgt_code"])


@query("p8_select_report_columns", oracle_with(["v_pairs"], """
SELECT src_id, CAST(length(src_code) AS BIGINT) AS src_code_len, CAST(length(tgt_code) AS BIGINT) AS tgt_code_len
FROM v_pairs"""))
def p8_select_report_columns(spark, sf):
    return rs.select_report_columns(_wide(spark, sf), names=["src_id"], suffixes=["_len"])


@query("p9_rename_runtime_columns", oracle_with(["v_inputs"], f"""
SELECT src_id, {fin('src_runtime')} AS src_code_agg_runtime, {fin('tgt_runtime')} AS tgt_code_agg_runtime FROM v_inputs"""))
def p9_rename_runtime_columns(spark, sf):
    d = rs.rename_runtime_columns(view(spark, sf, "v_inputs"), mapping={
        "src_runtime": "src_code_agg_runtime", "tgt_runtime": "tgt_code_agg_runtime"})
    return d.select("src_id", "src_code_agg_runtime", "tgt_code_agg_runtime")


@query("p10_split_cached_rows", oracle_with(["v_pairs"], _LONG + """
SELECT src_id, code_type, code_type = 'src_code' AS from_cache FROM long"""))
def p10_split_cached_rows(spark, sf):
    cached, todo = rs.split_cached_rows(_long(spark, sf), types=["src_code"])
    return rs.union_by_name(cached.withColumn("from_cache", F.lit(True)),
                            todo.withColumn("from_cache", F.lit(False))).select("src_id", "code_type", "from_cache")


@query("u1_union_by_name", """
SELECT item_id AS id, sha256(text) AS text_hash, CAST(NULL AS VARCHAR) AS lang FROM benchmark
UNION ALL SELECT doc_id, sha256(text), lang FROM documents""")
def u1_union_by_name(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.sha2("text", 256).alias("text_hash"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text_hash"), "lang")
    return rs.union_by_name(b, d)


@query("u3_array_set_algebra", oracle_with(["v_generations"], """
, s AS (SELECT src_id, list(code) FILTER (WHERE code IS NOT NULL) AS a,
          list(code) FILTER (WHERE code IS NOT NULL AND accuracy = 1.0) AS b FROM v_generations GROUP BY src_id)
, s2 AS (SELECT src_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
SELECT src_id, CAST(len(list_distinct(list_filter(a, lambda x: list_contains(b, x)))) AS BIGINT) AS n_intersect,
  CAST(len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS BIGINT) AS n_except,
  CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS n_union FROM s2"""))
def u3_array_set_algebra(spark, sf):
    g = view(spark, sf, "v_generations")
    s = g.groupBy("src_id").agg(F.collect_list("code").alias("a"),
                                F.collect_list(F.when(F.col("accuracy") == 1.0, F.col("code"))).alias("b"))
    return s.select("src_id", F.size(rs.array_set_algebra("a", "b", "intersect")).alias("n_intersect"),
                    F.size(rs.array_set_algebra("a", "b", "except")).alias("n_except"),
                    F.size(rs.array_set_algebra("a", "b", "union")).alias("n_union"))


@query("u4_partition_check", oracle_with(["v_submissions"], """
SELECT submission_id, 'missing' AS side FROM v_submissions WHERE submission_id % 50 = 7
UNION ALL SELECT submission_id, 'extra' FROM v_submissions WHERE submission_id % 50 = 9"""))
def u4_partition_check(spark, sf):
    """A split whose second part lost some rows and doubled others."""
    subs = view(spark, sf, "v_submissions")
    acc = au.accepted_finite(subs)
    rest = subs.join(acc.select("submission_id"), "submission_id", "left_anti")
    whole = rs.union_by_name(acc, rest)
    parts = rs.union_by_name(whole.filter("submission_id % 50 <> 7"), whole.filter("submission_id % 50 = 9"))
    return rs.partition_check(subs, parts).select("submission_id", "side")


@query("o4_order_work", oracle_with(["v_generations"], """
SELECT src_id, CAST(count(*) AS BIGINT) AS n_tests,
  string_agg(CAST(gen_idx AS VARCHAR), ',' ORDER BY gen_idx DESC) AS tests FROM v_generations GROUP BY src_id"""))
def o4_order_work(spark, sf):
    g = view(spark, sf, "v_generations").groupBy("src_id").agg(
        F.count(F.lit(1)).alias("n_tests"), F.collect_list("gen_idx").alias("tests"))
    d = rs.order_work(g, length="n_tests", tests="tests", key="src_id")
    return d.select("src_id", "n_tests", F.array_join(F.col("tests").cast("array<string>"), ",").alias("tests"))


@query("j5_merge_completions", oracle_with(["v_generations", "v_inputs"], """
, c AS (SELECT src_id, count(code) AS n FROM v_generations GROUP BY src_id)
SELECT i.src_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_completions FROM v_inputs i LEFT JOIN c USING (src_id)"""))
def j5_merge_completions(spark, sf):
    comp = view(spark, sf, "v_generations").groupBy("src_id").agg(F.count("code").alias("n"))
    d = rs.merge_completions(view(spark, sf, "v_inputs"), comp)
    return d.select("src_id", F.coalesce("n", F.lit(0)).alias("n_completions"))


# ---- sources and sinks -----------------------------------------------------

PAIR_SCHEMA = T.StructType([T.StructField("src_id", T.LongType()), T.StructField("problem_id", T.LongType()),
                            T.StructField("src_code", T.StringType()), T.StructField("tgt_code", T.StringType()),
                            T.StructField("speedup", T.DoubleType())])

_PAIRS_OUT = oracle_with(["v_pairs"], f"""
SELECT src_id, CAST(problem_id AS BIGINT) AS problem_id, sha256(src_code) AS src_hash, {fin('speedup')} AS speedup
FROM v_pairs""")


@query("s1_read_records", _PAIRS_OUT)
def s1_read_records(spark, sf):
    path = "/".join((checkpoint_dir(spark), "records", uuid.uuid4().hex))
    io.write_records(view(spark, sf, "v_pairs"), path)
    back = io.read_records(spark, path, PAIR_SCHEMA, required=["src_id", "src_code"])
    return back.select("src_id", "problem_id", F.sha2("src_code", 256).alias("src_hash"), "speedup")


@query("s10_stage", _PAIRS_OUT)
def s10_stage(spark, sf):
    path = "/".join((checkpoint_dir(spark), "stages", uuid.uuid4().hex))
    build = lambda: view(spark, sf, "v_pairs").select(
        "src_id", "problem_id", F.sha2("src_code", 256).alias("src_hash"), "speedup")
    io.stage(spark, path, build)  # computes and writes

    def must_not_run():
        raise AssertionError("a complete stage must be resumed, not recomputed")

    return io.stage(spark, path, must_not_run)  # resumes from the written stage


EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                             T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


@query("s3_read_csv_metrics", f"""
SELECT event_id, user_id, event_type, {fin('value')} AS value, false AS bad FROM events""")
def s3_read_csv_metrics(spark, sf):
    """Events written as CSV files with a header, read back; no row is malformed."""
    path = "/".join((checkpoint_dir(spark), "csv", uuid.uuid4().hex))
    table(spark, sf, "events").select(*EVENT_SCHEMA.fieldNames()).write.option("header", "true").csv(path)
    good, bad = io.read_csv_metrics(spark, path, EVENT_SCHEMA)
    nb = F.lit(False)
    return rs.union_by_name(good.drop("file").withColumn("bad", nb),
                            bad.select(F.lit(None).cast("long").alias("event_id"), F.lit(True).alias("bad")))


@query("s9_write_summary", oracle_with(["v_outputs"], """
, sig AS (SELECT program_id, string_agg(problem_id || ':' || tc_no || ':' || output, '|' ORDER BY problem_id, tc_no) AS s
          FROM v_outputs GROUP BY program_id)
, grp AS (SELECT s, count(*) AS m FROM sig GROUP BY s)
, one AS (SELECT CAST(sum(m) - sum(CASE WHEN m > 1 THEN m ELSE 0 END) + count(*) FILTER (WHERE m > 1) AS BIGINT) AS unique_programs,
            CAST(sum(m) AS BIGINT) AS total_programs FROM grp)
SELECT unique_programs, total_programs, e AS experiment FROM one, (VALUES ('first'), ('second')) AS x(e)"""))
def s9_write_summary(spark, sf):
    """The unique-program report appended twice as CSV; both experiments stay."""
    path = "/".join((checkpoint_dir(spark), "summary", uuid.uuid4().hex))
    rep = au.unique_program_count(view(spark, sf, "v_outputs")).select("unique_programs", "total_programs")
    io.write_summary(rep, path, experiment="first")
    io.write_summary(rep, path, experiment="second")
    schema = "unique_programs BIGINT, total_programs BIGINT, experiment STRING"
    return spark.read.schema(schema).option("header", "true").csv(path)


@query("s11_versioned_write", oracle_with(["v_pairs"], f"""
SELECT src_id, {fin('speedup')} AS speedup, v AS version FROM v_pairs, (VALUES ('v=a'), ('v=b')) AS x(v)"""))
def s11_versioned_write(spark, sf):
    """Two runs write side by side; the earlier copy is never overwritten."""
    root = "/".join((checkpoint_dir(spark), "versions", uuid.uuid4().hex))
    d = view(spark, sf, "v_pairs").select("src_id", "speedup")
    io.versioned_write(d, root, "a")
    io.versioned_write(d, root, "b")
    return (spark.read.parquet(root).withColumn("version", F.concat(F.lit("v="), F.col("v")))
            .select("src_id", "speedup", "version"))


TURN_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                            T.StructField("text", T.StringType())])


@query("s2_read_splits", """
SELECT conv_id, turn, sha256(text) AS text_hash, role AS split FROM conversations""")
def s2_read_splits(spark, sf):
    """Each role written as its own JSON-lines split, read back tagged."""
    root = "/".join((checkpoint_dir(spark), "splits", uuid.uuid4().hex))
    conv = table(spark, sf, "conversations")
    roles = ("system", "user", "assistant")
    for role in roles:
        io.write_records(conv.filter(F.col("role") == role).select(*TURN_SCHEMA.fieldNames()), f"{root}/{role}")
    d = io.read_splits(spark, {r: f"{root}/{r}" for r in roles}, TURN_SCHEMA)
    return d.select("conv_id", "turn", F.sha2("text", 256).alias("text_hash"), "split")


# ---- sources of named files ---------------------------------------------------

@query("s4_read_keyed_documents", r"""
SELECT 'p' || page_id AS key, sha256(regexp_replace(html, '^\s+|\s+$', '', 'g')) AS text_hash FROM pages""")
def s4_read_keyed_documents(spark, sf):
    """Every page written as a file of its own, read back by its name."""
    root = f"{checkpoint_dir(spark)}/named/{uuid.uuid4().hex}"
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".v1.html")).alias("name"),
                                             F.concat(F.lit(" \n"), F.col("html"), F.lit("\n")).alias("text"))
    io.write_named_texts(pages, root)
    return io.read_keyed_documents(spark, f"{root}/*.html").select("key", F.sha2("text", 256).alias("text_hash"))


@query("s5_read_testcases", """
SELECT 'c' || conv_id AS problem_id, CAST(turn AS BIGINT) AS tc_no, sha256(text) AS input_hash, sha256(role) AS expected_hash FROM conversations
WHERE turn <> 1""")
def s5_read_testcases(spark, sf):
    """Every turn as a test: input.N.txt and output.N.txt, one file of another name, and an allow-list as text."""
    root = f"{checkpoint_dir(spark)}/named/{uuid.uuid4().hex}"
    conv = table(spark, sf, "conversations")
    place = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"))
    name = lambda kind: F.concat(place, F.lit(f"{kind}."), F.col("turn").cast("string"), F.lit(".txt"))
    odd = conv.filter("turn = 0").select(F.concat(place, F.lit("input.big.txt")).alias("name"), F.col("text"))
    files = conv.select(name("input").alias("name"), "text").unionByName(conv.select(name("output").alias("name"), F.col("role").alias("text"))).unionByName(odd)
    io.write_named_texts(files, root, n_rows=2 * conv.count())
    allow = conv.filter("turn <> 1").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("problem_id"), F.col("turn").cast("string").alias("tc_no"))
    d = io.read_testcases(spark, root, allow)
    return d.select("problem_id", "tc_no", F.sha2("input", 256).alias("input_hash"), F.sha2("expected", 256).alias("expected_hash"))


@query("s7_read_timing_json", f"""
SELECT user_id AS submission_id, event_id AS tc_no, {fin('value')} AS mean, CAST(2 AS BIGINT) AS n_times FROM events WHERE event_id % 10 <> 4""")
def s7_read_timing_json(spark, sf):
    """A file of timings per submission; one command in ten names no input, and one more file is broken."""
    root = f"{checkpoint_dir(spark)}/named/{uuid.uuid4().hex}"
    e = F.col("event_id")
    command = F.concat(F.lit("./a.out < "), F.when(e % 10 == 4, F.lit("other.txt")).otherwise(F.concat(F.lit("input_"), e.cast("string"), F.lit(".txt"))))
    runs = table(spark, sf, "events").groupBy("user_id").agg(  # a user's own events
        F.to_json(F.struct(F.collect_list(F.struct(command.alias("command"), F.col("value").alias("mean"), F.array("value", "value").alias("times"))).alias("results"))).alias("text"))
    files = runs.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".json")).alias("name"), "text")
    broken = files.limit(1).select(F.lit("broken.json").alias("name"), F.lit("{broken").alias("text"))
    io.write_named_texts(files.unionByName(broken), root)
    d = io.read_timing_json(spark, root)
    return d.select(F.regexp_extract("file", r"u(\d+)\.json$", 1).cast("long").alias("submission_id"), "tc_no", "mean", F.size("times").alias("n_times"))


@query("s12_normalise_keyed_json", oracle_with(["v_outputs"], """
SELECT CAST(problem_id AS BIGINT) AS problem_id, CAST(tc_no AS BIGINT) AS tc_no, output, 'p' || program_id AS program_id FROM v_outputs"""))
def s12_normalise_keyed_json(spark, sf):
    """Outputs nested as {test: {output: [programs]}} per problem and block of programs, then flattened."""
    o = view(spark, sf, "v_outputs").withColumn("block", F.floor(F.col("program_id") / 64))
    ids = o.groupBy("problem_id", "block", "tc_no", "output").agg(F.collect_list(F.concat(F.lit("p"), F.col("program_id").cast("string"))).alias("ids"))
    per_test = ids.groupBy("problem_id", "block", "tc_no").agg(F.map_from_entries(F.collect_list(F.struct("output", "ids"))).alias("m"))
    nested = per_test.groupBy("problem_id", "block").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("tc_no").cast("string"), "m")))).alias("j"))
    return io.normalise_keyed_json(nested.drop("block"), "j").select("problem_id", "tc_no", "output", "program_id")


@query("s3_read_csv_metrics_headers", f"""
SELECT event_id, user_id, event_type, {fin('value')} AS value, false AS bad FROM events
UNION ALL SELECT event_id, NULL, NULL, NULL, true FROM events WHERE event_id % 20 = 3""")
def s3_read_csv_metrics_headers(spark, sf):
    """Half the files have their columns in another order, and some rows are malformed."""
    path = f"{checkpoint_dir(spark)}/csv/{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select(*EVENT_SCHEMA.fieldNames())
    e.filter("event_id % 2 = 0").write.option("header", "true").csv(f"{path}/a")
    e.filter("event_id % 2 = 1").select("value", "event_type", "event_id", "user_id").write.option("header", "true").csv(f"{path}/b")
    e.filter("event_id % 20 = 3").select(F.concat(F.lit("x"), F.col("event_id").cast("string"), F.lit(",y,z"))).write.text(f"{path}/c")
    good, bad = io.read_csv_metrics(spark, f"{path}/*", EVENT_SCHEMA)
    return rs.union_by_name(good.drop("file").withColumn("bad", F.lit(False)),
                            bad.select(F.regexp_extract("raw", r"^x(\d+),", 1).cast("long").alias("event_id"), F.lit(True).alias("bad")))


@query("s3_read_csv_metrics_breaks", """
SELECT conv_id, turn, sha256(text) AS text_hash, false AS bad FROM conversations
UNION ALL SELECT conv_id, NULL, NULL, true FROM conversations WHERE turn = 1""")
def s3_read_csv_metrics_breaks(spark, sf):
    """Texts with line breaks and quotes as CSV values, and some broken rows."""
    path = f"{checkpoint_dir(spark)}/csv/{uuid.uuid4().hex}"
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    conv.write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(f"{path}/a")
    conv.filter("turn = 1").select(F.concat(F.lit("x"), F.col("conv_id").cast("string"), F.lit(",1,a,b"))).write.text(f"{path}/b")
    good, bad = io.read_csv_metrics(spark, f"{path}/*/*.csv,{path}/*/*.txt".split(","), TURN_SCHEMA, multiline=True)
    return rs.union_by_name(good.select("conv_id", "turn", F.sha2("text", 256).alias("text_hash"), F.lit(False).alias("bad")),
                            bad.select(F.regexp_extract("raw", r"^x(\d+),", 1).cast("long").alias("conv_id"), F.lit(True).alias("bad")))
