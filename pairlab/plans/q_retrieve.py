"""Checked queries for RETR."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import retrieve as rt
from pairlab.plans.fixtures import oracle_with, table, view
from pairlab.plans.registry import fin, query, sql_str, template_sql


def letters_sql(t: str) -> str:
    low = f"lower({t})"
    return "[" + ", ".join(f"CAST(length({low}) - length(replace({low}, '{ch}', '')) AS DOUBLE)"
                           for ch in rt.LETTERS) + "]"


@query("u2_distinct_sources", "SELECT DISTINCT sha256(text) AS text_hash FROM documents")
def u2_distinct_sources(spark, sf):
    return rt.distinct_sources(table(spark, sf, "documents"), "text").select("text_hash")


@query("f12_encode_text", f"""
SELECT doc_id, array_to_string(list_transform({letters_sql('text')}, lambda x: CAST(x AS BIGINT)), ',') AS vector
FROM documents""")
def f12_encode_text(spark, sf):
    d = rt.encode_text(table(spark, sf, "documents"), "text")
    return d.select("doc_id", F.array_join(F.col("embedding").cast("array<bigint>").cast("array<string>"), ",")
                    .alias("vector"))


@query("j7_knn_join", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
, d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS dist
  FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT query_id, neighbor_id, CAST(rank AS BIGINT) AS rank, {fin('dist')} AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS rank FROM d) WHERE rank <= 4""")
def j7_knn_join(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = e.withColumnRenamed("vec_id", "query_id")
    c = e.withColumnRenamed("vec_id", "neighbor_id")
    return rt.knn_join(q, c, k=4, qkey="query_id", ckey="neighbor_id").select(
        "query_id", "neighbor_id", "rank", "dist")


@query("j7_knn_join_string_ids", f"""
WITH e AS (SELECT 'v' || vec_id AS id, CASE WHEN vec_id % 10 <> 3 THEN CAST(embedding AS DOUBLE[]) END AS v FROM embeddings)
, d AS (SELECT a.id AS query_id, b.id AS neighbor_id,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS dist
  FROM e a JOIN e b ON a.id <> b.id WHERE a.v IS NOT NULL AND b.v IS NOT NULL)
SELECT query_id, neighbor_id, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS rank FROM d) WHERE rank <= 2""")
def j7_knn_join_string_ids(spark, sf):
    """String ids; every tenth row has no vector."""
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"),
                                              F.when(F.col("vec_id") % 10 != 3, F.col("embedding")).alias("embedding"))
    return rt.knn_join(e.withColumnRenamed("id", "query_id"), e.withColumnRenamed("id", "neighbor_id"), k=2, qkey="query_id", ckey="neighbor_id",
                       corpus_partitions=3).select("query_id", "neighbor_id", "rank")


_BEST = """
, bestid AS (SELECT sha256(src_code) AS code_hash, arg_min(src_id, (-speedup, src_id)) AS src_id
             FROM v_pairs GROUP BY sha256(src_code))
, b AS (SELECT p.*, bestid.code_hash FROM v_pairs p JOIN bestid USING (src_id))
"""


@query("a12_best_pair_per_source", oracle_with(["v_pairs"], _BEST + f"""
SELECT code_hash, src_id, {fin('speedup')} AS speedup FROM b"""))
def a12_best_pair_per_source(spark, sf):
    return rt.best_pair_per_source(view(spark, sf, "v_pairs")).select("code_hash", "src_id", "speedup")


_NL1 = "chr(10) || '+'"
_PROMPT = template_sql(rt.EXAMPLE_TEMPLATE, {
    "src_code": f"regexp_replace(b.src_code, {_NL1}, chr(10), 'g')",
    "tgt_code": f"regexp_replace(b.tgt_code, {_NL1}, chr(10), 'g')"})
_SEP = sql_str(rt.EXAMPLE_SEPARATOR)
_INPUT = template_sql(rt.QUERY_TEMPLATE, {"examples": "f.ex", "src_code": "p.src_code"})

_RETR = _BEST + f"""
, cv AS (SELECT src_id AS neighbor_id, code_hash, {letters_sql('src_code')} AS v FROM b)
, qv AS (SELECT src_id AS query_id, sha256(src_code) AS q_hash, src_code, {letters_sql('src_code')} AS v FROM v_pairs)
, d AS (SELECT q.query_id, c.neighbor_id,
    list_sum(list_transform(range(1, 27), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))) AS dist
    FROM qv q JOIN cv c ON q.q_hash <> c.code_hash)
, nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS rank FROM d QUALIFY rank <= 4)
, pr AS (SELECT nn.query_id, nn.neighbor_id, nn.rank,
    {_PROMPT} AS prompt
    FROM nn JOIN b ON b.src_id = nn.neighbor_id)
"""


def _neighbours(spark, sf):
    pairs = view(spark, sf, "v_pairs")
    best = rt.best_pair_per_source(pairs)
    corpus = rt.encode_text(best.select(F.col("src_id").alias("neighbor_id"), "code_hash", "src_code"), "src_code")
    q = rt.encode_text(pairs.select(F.col("src_id").alias("query_id"), "src_code",
                                    F.sha2(F.col("src_code"), 256).alias("q_hash")), "src_code")
    nn = rt.knn_join(q, corpus, k=4, qkey="q_hash", ckey="code_hash")
    return rt.lookup_best_pair(nn, best)


@query("j10_lookup_best_pair", oracle_with(["v_pairs"], _RETR + f"""
SELECT query_id, CAST(rank AS BIGINT) AS rank, neighbor_id, sha256(prompt) AS prompt_hash FROM pr"""))
def j10_lookup_best_pair(spark, sf):
    return _neighbours(spark, sf).select("query_id", "rank", "neighbor_id",
                                         F.sha2(F.col("prompt"), 256).alias("prompt_hash"))


_FEWSHOT = oracle_with(["v_pairs"], _RETR + f"""
, f AS (SELECT query_id, count(*) AS n_examples, string_agg(prompt, {_SEP} ORDER BY rank DESC) AS ex
        FROM pr GROUP BY query_id)
, x AS (SELECT f.query_id, f.n_examples, {_INPUT} AS input
        FROM f JOIN v_pairs p ON p.src_id = f.query_id)
SELECT query_id, CAST(n_examples AS BIGINT) AS n_examples, CAST(length(input) AS BIGINT) AS input_length,
  sha256(input) AS input_hash FROM x""")


@query("f6_fewshot_prompt", _FEWSHOT)
def f6_fewshot_prompt(spark, sf):
    out = rt.retrieve_prompts(view(spark, sf, "v_pairs"), view(spark, sf, "v_pairs"))
    return out.select("query_id", "n_examples", F.length("input").alias("input_length"),
                      F.sha2(F.col("input"), 256).alias("input_hash"))


@query("f6_fewshot_prompt_pivots", _FEWSHOT)
def f6_fewshot_prompt_pivots(spark, sf):
    """The same prompts, neighbours searched with bounds."""
    out = rt.retrieve_prompts(view(spark, sf, "v_pairs"), view(spark, sf, "v_pairs"), pivots=True)
    return out.select("query_id", "n_examples", F.length("input").alias("input_length"),
                      F.sha2(F.col("input"), 256).alias("input_hash"))
