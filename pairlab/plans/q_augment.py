"""Checked queries for AUG."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import text as tx
from pairlab.operators import augment as au
from pairlab.plans.fixtures import oracle_with, table, view
from pairlab.plans.registry import fin, query

TOKEN_SQL = r"[\pL\pN_]+|[^\pL\pN_\s]"


def ntok(expr: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all({expr}, '{TOKEN_SQL}')), 0) AS BIGINT)"


def html_text_sql(expr: str) -> str:
    t = (f"regexp_replace(regexp_replace({expr}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'),"
         f" '<[^>]*>', ' ', 'g')")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    t = f"trim(regexp_replace({t}, '[ \\t]+', ' ', 'g'))"
    return f"(CASE WHEN length({t}) < 25 THEN {expr} ELSE {t} END)"


# ---- seeds -------------------------------------------------------------------

_ACC = """
, acc AS (SELECT submission_id, problem_id, agg_runtime FROM v_submissions
          WHERE status = 'Accepted' AND agg_runtime IS NOT NULL AND isfinite(agg_runtime))
"""


def _accepted(spark, sf):
    return au.accepted_finite(view(spark, sf, "v_submissions")).select(
        "submission_id", "problem_id", "agg_runtime")


@query("p3_accepted_finite", oracle_with(["v_submissions"], _ACC + f"""
SELECT submission_id, problem_id, {fin('agg_runtime')} AS agg_runtime FROM acc"""))
def p3_accepted_finite(spark, sf):
    return _accepted(spark, sf)


_TOP = _ACC + """
, top AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY agg_runtime, submission_id) AS rank
          FROM acc QUALIFY rank <= 10)
"""


@query("w3_top_n_per_problem", oracle_with(["v_submissions"], _TOP + f"""
SELECT submission_id, problem_id, {fin('agg_runtime')} AS agg_runtime, CAST(rank AS BIGINT) AS rank FROM top"""))
def w3_top_n_per_problem(spark, sf):
    return au.top_n_per_problem(_accepted(spark, sf))


_SEEDS = _TOP + """
, total AS (SELECT problem_id, count(*) AS n_accepted FROM acc GROUP BY problem_id)
, seeds AS (SELECT problem_id, arg_min(submission_id, (agg_runtime, submission_id)) AS submission_id,
    min(agg_runtime) AS agg_runtime, count(*) AS num_submissions, any_value(n_accepted) AS n_accepted
    FROM top JOIN total USING (problem_id) GROUP BY problem_id)
"""


def _seeds(spark, sf):
    return au.fastest_correct(_accepted(spark, sf), program="submission_id")


@query("a13_fastest_accepted", oracle_with(["v_submissions"], _SEEDS + f"""
SELECT problem_id, submission_id, {fin('agg_runtime')} AS agg_runtime,
  CAST(num_submissions AS BIGINT) AS num_submissions FROM seeds"""))
def a13_fastest_accepted(spark, sf):
    return _seeds(spark, sf).select("problem_id", "submission_id", "agg_runtime", "num_submissions")


@query("j2_attach_descriptions", oracle_with(["v_submissions"], _SEEDS + f"""
SELECT s.problem_id, s.submission_id, p.url IS NOT NULL AS has_description,
  {ntok(html_text_sql('p.html'))} AS text_description_length
FROM seeds s LEFT JOIN pages p ON p.page_id = s.problem_id
WHERE s.problem_id NOT IN (SELECT item_id FROM benchmark)"""))
def j2_attach_descriptions(spark, sf):
    desc = table(spark, sf, "pages").select(
        F.col("page_id").alias("problem_id"), "url",
        tx.html_to_text_regex(F.col("html")).alias("text_description"))
    deny = table(spark, sf, "benchmark").select(F.col("item_id").alias("problem_id"))
    out = au.attach_descriptions(_seeds(spark, sf), desc, deny=deny)
    return out.select("problem_id", "submission_id", F.col("url").isNotNull().alias("has_description"),
                      F.when(F.col("text_description").isNull(), F.lit(0)).otherwise(
                          tx.token_length(F.col("text_description"))).alias("text_description_length"))


@query("a13_fastest_of_all", oracle_with(["v_submissions"], _SEEDS + f"""
SELECT problem_id, submission_id, {fin('agg_runtime')} AS agg_runtime,
  CAST(n_accepted AS BIGINT) AS num_submissions, CAST(n_accepted AS BIGINT) AS n_accepted FROM seeds"""))
def a13_fastest_of_all(spark, sf):
    """No cut: every accepted submission is examined and counted."""
    return au.fastest_correct(_accepted(spark, sf), program="submission_id", top=None).select(
        "problem_id", "submission_id", "agg_runtime", "num_submissions", "n_accepted")


@query("o3_sample_candidates", oracle_with(["v_submissions"], _SEEDS + """
SELECT problem_id, CAST(n_accepted AS BIGINT) AS n_accepted FROM seeds
ORDER BY n_accepted DESC, problem_id LIMIT 10"""))
def o3_sample_candidates(spark, sf):
    return au.sample_candidates(_seeds(spark, sf), 10, mode="top").select("problem_id", "n_accepted")


def _o3_random_sql(seed: int) -> str:
    from pairlab.functions.text import seeded_hash_sql
    return oracle_with(["v_submissions"], _SEEDS + f"""
SELECT 'p' || problem_id AS problem_id FROM seeds ORDER BY {seeded_hash_sql("'p' || problem_id", seed=seed)}, 1 LIMIT 20""")


@query("o3_sample_candidates_random", _o3_random_sql(5))
def o3_sample_candidates_random(spark, sf):
    """A seeded sample over string ids."""
    seeds = _seeds(spark, sf).withColumn("problem_id", F.concat(F.lit("p"), F.col("problem_id").cast("string")))
    return au.sample_candidates(seeds, 20, mode="random", seed=5).select("problem_id")


@query("o5_replicate_seeds", oracle_with(["v_submissions"], _SEEDS + """
SELECT problem_id, CAST(r AS BIGINT) AS replica FROM seeds, unnest(range(1, 4)) AS u(r)"""))
def o5_replicate_seeds(spark, sf):
    return au.replicate_seeds(_seeds(spark, sf), 30).select("problem_id", "replica")


# ---- tests and correctness ---------------------------------------------------

# Test table that grows with the data: every order is a test case (tc_no) of
# its customer's problem.
_TESTS_SQL = "SELECT o_custkey AS problem_id, o_orderkey AS tc_no FROM orders"


def _tests(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("problem_id"),
                                             F.col("o_orderkey").alias("tc_no"))


@query("w5_top_tests", f"""
WITH t AS ({_TESTS_SQL})
SELECT problem_id, tc_no FROM t
QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY tc_no DESC) <= 20""")
def w5_top_tests(spark, sf):
    return au.top_tests(_tests(spark, sf)).select("problem_id", "tc_no")


@query("a15_count_tests", f"""
WITH t AS ({_TESTS_SQL})
SELECT problem_id, CAST(count(*) AS BIGINT) AS n_tests FROM t GROUP BY problem_id HAVING count(*) >= 20""")
def a15_count_tests(spark, sf):
    return au.count_tests(_tests(spark, sf))


_PASS = r"""
, j AS (SELECT o.problem_id, o.program_id,
    coalesce(o.output NOT IN ('timeout', 'error') AND regexp_replace(o.output, '^\s+|\s+$', '', 'g')
      = regexp_replace(e.expected, '^\s+|\s+$', '', 'g'), false) AS ok
  FROM v_outputs o LEFT JOIN v_expected e ON o.problem_id = e.problem_id AND o.tc_no = e.tc_no)
, ne AS (SELECT problem_id, count(*) AS n FROM v_expected GROUP BY problem_id)
, pass AS (SELECT j.problem_id, j.program_id, count(*) FILTER (WHERE ok) = coalesce(any_value(ne.n), 0) AS passed
  FROM j LEFT JOIN ne USING (problem_id) GROUP BY j.problem_id, j.program_id)
"""


def _passed(spark, sf):
    return au.all_tests_pass(view(spark, sf, "v_outputs"), view(spark, sf, "v_expected"))


@query("a14_all_tests_pass", oracle_with(["v_outputs", "v_expected"], _PASS + """
SELECT CAST(problem_id AS BIGINT) AS problem_id, program_id, passed FROM pass"""))
def a14_all_tests_pass(spark, sf):
    return _passed(spark, sf)


@query("a13_fastest_correct", oracle_with(["v_outputs", "v_expected"], _PASS + f"""
, subs AS (SELECT DISTINCT o.problem_id, o.program_id, c.c_acctbal AS agg_runtime
           FROM v_outputs o JOIN customer c ON c.c_custkey = o.program_id)
, top AS (SELECT * FROM subs QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY agg_runtime, program_id) <= 10)
, num AS (SELECT problem_id, count(*) AS num_submissions FROM top GROUP BY problem_id)
, ok AS (SELECT t.* FROM top t JOIN pass p USING (problem_id, program_id) WHERE p.passed)
, best AS (SELECT problem_id, arg_min(program_id, (agg_runtime, program_id)) AS program_id,
    min(agg_runtime) AS agg_runtime FROM ok GROUP BY problem_id)
SELECT CAST(problem_id AS BIGINT) AS problem_id, program_id, {fin('agg_runtime')} AS agg_runtime,
  CAST(num_submissions AS BIGINT) AS num_submissions FROM best JOIN num USING (problem_id)"""))
def a13_fastest_correct(spark, sf):
    outs = view(spark, sf, "v_outputs")
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("program_id"),
                                               F.col("c_acctbal").alias("agg_runtime"))
    subs = outs.select("problem_id", "program_id").distinct().join(cust, "program_id")
    return au.fastest_correct(subs, _passed(spark, sf)).select(
        "problem_id", "program_id", "agg_runtime", "num_submissions")


# ---- equivalence -------------------------------------------------------------

@query("a9_output_groups", oracle_with(["v_outputs"], """
SELECT CAST(problem_id AS BIGINT) AS problem_id, CAST(tc_no AS BIGINT) AS tc_no, sha256(output) AS output_hash,
  CAST(count(*) AS BIGINT) AS n_programs, min(program_id) AS min_program, max(program_id) AS max_program
FROM v_outputs GROUP BY problem_id, tc_no, output"""))
def a9_output_groups(spark, sf):
    return au.output_groups(view(spark, sf, "v_outputs"))


_SIG = """
, sig AS (SELECT program_id, string_agg(problem_id || ':' || tc_no || ':' || output, '|' ORDER BY problem_id, tc_no) AS s
          FROM v_outputs GROUP BY program_id)
, grp AS (SELECT s, count(*) AS m, min(program_id) AS cluster_id, max(program_id) AS max_member FROM sig GROUP BY s)
"""


@query("a10_always_co_located", oracle_with(["v_outputs"], _SIG + """
SELECT cluster_id, CAST(m AS BIGINT) AS n_members, max_member FROM grp WHERE m > 1"""))
def a10_always_co_located(spark, sf):
    return au.co_located_sets(view(spark, sf, "v_outputs"))


@query("a11_unique_program_count", oracle_with(["v_outputs"], _SIG + f"""
SELECT CAST(sum(m) - sum(CASE WHEN m > 1 THEN m ELSE 0 END) + count(*) FILTER (WHERE m > 1) AS BIGINT) AS unique_programs,
  CAST(sum(m) AS BIGINT) AS total_programs,
  {fin('100.0 * (sum(m) - sum(CASE WHEN m > 1 THEN m ELSE 0 END) + count(*) FILTER (WHERE m > 1)) / sum(m)')} AS percent_unique,
  CAST(count(*) FILTER (WHERE m > 1) AS BIGINT) AS n_sets FROM grp"""))
def a11_unique_program_count(spark, sf):
    return au.unique_program_count(view(spark, sf, "v_outputs"))


@query("w6_keep_one_per_cluster", oracle_with(["v_outputs"], _SIG + """
SELECT cluster_id AS program_id, CAST(m AS BIGINT) AS n_equivalent FROM grp"""))
def w6_keep_one_per_cluster(spark, sf):
    return au.keep_one_per_cluster(view(spark, sf, "v_outputs")).select("program_id", "n_equivalent")


@query("w7_assign_ids", oracle_with(["v_outputs"], _SIG + """
SELECT cluster_id AS program_id, 'generated_' || CAST(row_number() OVER (ORDER BY cluster_id) - 1 AS VARCHAR) AS gen_id
FROM grp"""))
def w7_assign_ids(spark, sf):
    survivors = au.keep_one_per_cluster(view(spark, sf, "v_outputs")).select("program_id")
    return au.assign_ids(survivors, order=["program_id"])


@query("w7_assign_ids_lineitem", f"""
SELECT l_orderkey, l_linenumber, {fin('l_extendedprice')} AS price,
  'generated_' || CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS VARCHAR) AS gen_id
FROM lineitem""")
def w7_assign_ids_lineitem(spark, sf):
    """Every line item numbered, with a column that is not part of the order."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    out = au.assign_ids(d, order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), "gen_id")


# ---- novelty -----------------------------------------------------------------

_TOP20 = """
, chosen AS (SELECT problem_id, tc_no FROM (SELECT DISTINCT problem_id, tc_no FROM v_outputs)
             QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY tc_no DESC) <= 20)
, nch AS (SELECT problem_id, count(*) AS n FROM chosen GROUP BY problem_id)
, c AS (SELECT o.* FROM v_outputs o JOIN chosen USING (problem_id, tc_no) WHERE kind = 'candidate')
, r AS (SELECT o.* FROM v_outputs o JOIN chosen USING (problem_id, tc_no) WHERE kind = 'reference')
, agree AS (SELECT c.problem_id, c.program_id AS cand, r.program_id AS ref, count(*) AS k
            FROM c JOIN r ON c.problem_id = r.problem_id AND c.tc_no = r.tc_no AND c.output = r.output
            GROUP BY ALL)
, nm AS (SELECT a.problem_id, a.cand, count(*) AS n_matching FROM agree a JOIN nch USING (problem_id)
         WHERE a.k = nch.n GROUP BY ALL)
, cands AS (SELECT problem_id, program_id, count(*) FILTER (WHERE output IN ('timeout', 'error')) = 0 AS runs_all
            FROM v_outputs WHERE kind = 'candidate' GROUP BY ALL)
"""


@query("j8_match_outputs", oracle_with(["v_outputs"], _TOP20 + """
SELECT CAST(cands.problem_id AS BIGINT) AS problem_id, cands.program_id,
  CAST(coalesce(nm.n_matching, 0) AS BIGINT) AS n_matching
FROM cands LEFT JOIN nm ON nm.problem_id = cands.problem_id AND nm.cand = cands.program_id"""))
def j8_match_outputs(spark, sf):
    o = view(spark, sf, "v_outputs")
    chosen = au.top_tests(o.select("problem_id", "tc_no").distinct())
    return au.match_outputs(o.filter("kind = 'candidate'"), o.filter("kind = 'reference'"), chosen).drop("class_id")


@query("a8_novelty_filter", oracle_with(["v_outputs"], _TOP20 + """
SELECT CAST(cands.problem_id AS BIGINT) AS problem_id, cands.program_id, runs_all,
  CAST(coalesce(nm.n_matching, 0) AS BIGINT) AS n_matching,
  runs_all AND coalesce(nm.n_matching, 0) = 0 AS is_different
FROM cands LEFT JOIN nm ON nm.problem_id = cands.problem_id AND nm.cand = cands.program_id"""))
def a8_novelty_filter(spark, sf):
    o = view(spark, sf, "v_outputs")
    return au.novelty_filter(o.filter("kind = 'candidate'"), o.filter("kind = 'reference'"),
                             o.select("problem_id", "tc_no"))


# outputs with holes: candidates that skipped tests, NULL outputs, and (below)
# programs that are novel for one problem only
_GAPS = """
, gaps AS (SELECT problem_id, tc_no, program_id, kind,
    CASE WHEN program_id % 11 = 0 AND tc_no = 3 THEN NULL
         WHEN kind = 'candidate' AND program_id % 3 = 0 AND problem_id = 2 THEN 'own ' || program_id
         ELSE output END AS output
  FROM v_outputs WHERE NOT (program_id % 13 = 0 AND tc_no % 5 = 1))
, every AS (SELECT DISTINCT problem_id, tc_no FROM gaps)
, n_every AS (SELECT problem_id, count(*) AS n FROM every GROUP BY problem_id)
, chosen AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY tc_no DESC) <= 20)
, nch AS (SELECT problem_id, count(*) AS n FROM chosen GROUP BY problem_id)
, c AS (SELECT o.* FROM gaps o JOIN chosen USING (problem_id, tc_no) WHERE kind = 'candidate')
, r AS (SELECT o.* FROM gaps o JOIN chosen USING (problem_id, tc_no) WHERE kind = 'reference')
, agree AS (SELECT c.problem_id, c.program_id AS cand, r.program_id AS ref, count(*) AS k
            FROM c JOIN r ON c.problem_id = r.problem_id AND c.tc_no = r.tc_no AND c.output = r.output GROUP BY ALL)
, matches AS (SELECT a.problem_id, a.cand, a.ref FROM agree a JOIN nch USING (problem_id) WHERE a.k = nch.n)
, nm AS (SELECT problem_id, cand, count(*) AS n_matching FROM matches GROUP BY ALL)
, ran AS (SELECT problem_id, program_id, count(DISTINCT CASE WHEN output IS NOT NULL AND output NOT IN ('timeout', 'error') THEN tc_no END) AS n_run
          FROM gaps WHERE kind = 'candidate' GROUP BY ALL)
, verdict AS (SELECT ran.problem_id, ran.program_id, n_run = n AS runs_all, coalesce(n_matching, 0) AS n_matching
  FROM ran JOIN n_every USING (problem_id) LEFT JOIN nm ON nm.problem_id = ran.problem_id AND nm.cand = ran.program_id)
"""


def _gaps(spark, sf):
    p, t = F.col("program_id"), F.col("tc_no")
    out = (F.when((p % 11 == 0) & (t == 3), F.lit(None).cast("string"))
           .when((F.col("kind") == "candidate") & (p % 3 == 0) & (F.col("problem_id") == 2), F.concat(F.lit("own "), p.cast("string")))
           .otherwise(F.col("output")))
    return view(spark, sf, "v_outputs").filter(~((p % 13 == 0) & (t % 5 == 1))).withColumn("output", out)


@query("a8_novelty_filter_gaps", oracle_with(["v_outputs"], _GAPS + """
SELECT CAST(problem_id AS BIGINT) AS problem_id, program_id, runs_all, CAST(n_matching AS BIGINT) AS n_matching,
  runs_all AND n_matching = 0 AS is_different FROM verdict"""))
def a8_novelty_filter_gaps(spark, sf):
    o = _gaps(spark, sf)
    return au.novelty_filter(o.filter("kind = 'candidate'"), o.filter("kind = 'reference'"), o.select("problem_id", "tc_no"))


@query("j8_match_classes", oracle_with(["v_outputs"], _GAPS + """
, cls AS (SELECT problem_id, cand, min(ref) AS class_id FROM matches GROUP BY ALL)
SELECT CAST(problem_id AS BIGINT) AS problem_id, class_id, false AS is_reference, cand AS program_id FROM cls
UNION ALL
SELECT DISTINCT CAST(m.problem_id AS BIGINT), cls.class_id, true, m.ref FROM matches m JOIN cls USING (problem_id, cand)"""))
def j8_match_classes(spark, sf):
    """Classes with a candidate: the candidates and the references they match."""
    o = _gaps(spark, sf)
    chosen = au.top_tests(o.select("problem_id", "tc_no").distinct())
    m = au.match_classes(o.filter("kind = 'candidate'"), o.filter("kind = 'reference'"), chosen)
    with_candidate = m.filter("NOT is_reference").select("problem_id", "class_id").distinct()
    return m.join(with_candidate, ["problem_id", "class_id"], "left_semi").select("problem_id", "class_id", "is_reference", "program_id")


@query("select_novel_gaps", oracle_with(["v_outputs"], _GAPS + """
, novel AS (SELECT problem_id, program_id FROM verdict WHERE runs_all AND n_matching = 0)
, nov_out AS (SELECT g.* FROM gaps g JOIN novel USING (problem_id, program_id) WHERE kind = 'candidate')
, sig AS (SELECT program_id, string_agg(problem_id || ':' || tc_no || ':' || output, '|' ORDER BY problem_id, tc_no) AS s
          FROM nov_out GROUP BY program_id)
, grp AS (SELECT s, count(*) AS m, min(program_id) AS cluster_id FROM sig GROUP BY s)
SELECT cluster_id AS program_id, 'generated_' || CAST(row_number() OVER (ORDER BY cluster_id) - 1 AS VARCHAR) AS gen_id,
  CAST(m AS BIGINT) AS n_equivalent FROM grp"""))
def select_novel_gaps(spark, sf):
    from pairlab.plans.jobs import select_novel
    return select_novel(_gaps(spark, sf))["survivors"].select("program_id", "gen_id", "n_equivalent")


# ---- descriptions, prompts, cost -------------------------------------------

def _problems(spark, sf):
    """Problem records from pages: description text and its token lengths."""
    p = table(spark, sf, "pages").select(
        F.col("page_id").alias("problem_id"), F.col("url").alias("code"),
        tx.html_to_text_regex(F.col("html")).alias("text_description"))
    return au.with_lengths(p)


_PROB = f"""
, prob AS (SELECT page_id AS problem_id, {ntok('url')} AS code_length,
    {ntok(html_text_sql('html'))} AS text_description_length FROM pages)
, prob2 AS (SELECT *, code_length + text_description_length AS total_length FROM prob)
"""


@query("f2_html_to_text", f"""
SELECT page_id, {html_text_sql('html')} AS text_description FROM pages""")
def f2_html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.html_to_text_regex(F.col("html")).alias("text_description"))


@query("f2_html_to_text_parser")
def f2_html_to_text_parser(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text_description"))


@query("f3_token_length", f"""
SELECT doc_id, {ntok('text')} AS n_tokens FROM documents""")
def f3_token_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.token_length(F.col("text")).alias("n_tokens"))


@query("f4_canonical_newlines", r"""
, d AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)) AS t FROM documents)
SELECT doc_id, CAST(length(regexp_replace(t, '\n+', chr(10), 'g')) AS BIGINT) AS len_keep1,
  sha256(regexp_replace(t, '\n{2,}', chr(10) || chr(10), 'g')) AS hash_keep2 FROM d""")
def f4_canonical_newlines(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n\n")).alias("t"))
    return d.select("doc_id", F.length(tx.canonical_newlines(F.col("t"), 1)).alias("len_keep1"),
                    F.sha2(tx.canonical_newlines(F.col("t"), 2), 256).alias("hash_keep2"))


@query("a18_short_description_report", _PROB + """
SELECT problem_id, text_description_length AS n_tokens, text_description_length < 25 AS is_short FROM prob2""")
def a18_short_description_report(spark, sf):
    p = _problems(spark, sf)
    return au.short_description_report(p).select(
        "problem_id", "n_tokens", "is_short")


def _j6_sql(seed: int, max_len: int, draws: int) -> str:
    from pairlab.functions.text import seeded_hash_sql
    return _PROB + f"""
, ranked AS (SELECT *, row_number() OVER (ORDER BY problem_id) - 1 AS rk FROM prob2)
, n AS (SELECT count(*) AS n FROM prob2)
, tried AS (SELECT p.problem_id AS candidate_id, p.total_length AS clen, d AS draw,
    {seeded_hash_sql('p.problem_id', 'd', seed=seed)} % (SELECT n FROM n) AS rk
    FROM prob2 p, unnest(range(0, {draws})) AS u(d))
, hit AS (SELECT t.candidate_id, t.draw, r.problem_id AS partner_id FROM tried t JOIN ranked r USING (rk)
          WHERE t.clen + r.total_length <= {max_len} AND r.text_description_length > 0)
, first AS (SELECT candidate_id, arg_min(partner_id, draw) AS partner_id, min(draw) AS draw FROM hit GROUP BY ALL)
SELECT p.problem_id AS candidate_id, CAST(f.draw AS BIGINT) AS draw, f.partner_id
FROM prob2 p LEFT JOIN first f ON f.candidate_id = p.problem_id"""


def _j6_orders_sql(seed: int, draws: int) -> str:
    from pairlab.functions.text import seeded_hash_sql
    return f"""
WITH p AS (SELECT 'o' || o_orderkey AS id, CAST(o_totalprice AS BIGINT) % 400 AS len, o_custkey % 3 AS dlen FROM orders)
, ranked AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rk FROM p)
, tried AS (SELECT p.id AS candidate_id, p.len AS clen, d AS draw,
    {seeded_hash_sql('p.id', 'd', seed=seed)} % (SELECT count(*) FROM p) AS rk FROM p, unnest(range(0, {draws})) AS u(d))
, hit AS (SELECT t.candidate_id, t.draw, r.id AS partner_id FROM tried t JOIN ranked r USING (rk) WHERE t.clen + r.len <= 500 AND r.dlen > 0)
, first AS (SELECT candidate_id, arg_min(partner_id, draw) AS partner_id, min(draw) AS draw FROM hit GROUP BY ALL)
SELECT p.id AS candidate_id, CAST(f.draw AS BIGINT) AS draw, f.partner_id FROM p LEFT JOIN first f ON f.candidate_id = p.id"""


@query("j6_sample_context_pairs_orders", _j6_orders_sql(seed=3, draws=5))
def j6_sample_context_pairs_orders(spark, sf):
    """A pool of all orders with string ids."""
    p = table(spark, sf, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("problem_id"),
        (F.round("o_totalprice").cast("bigint") % 400).alias("total_length"), (F.col("o_custkey") % 3).alias("text_description_length"))
    return au.sample_context_pairs(p, p, max_len=500, draws=5, seed=3)


@query("j6_sample_context_pairs", _j6_sql(seed=7, max_len=700, draws=25))
def j6_sample_context_pairs(spark, sf):
    p = _problems(spark, sf)
    return au.sample_context_pairs(p, p, max_len=700, draws=25, seed=7)


@query("a16_cost_report", f"""
, firsts AS (SELECT conv_id, arg_min(text, turn) AS template FROM conversations GROUP BY conv_id)
, comp AS (SELECT c.conv_id, c.turn, c.text AS code, f.template FROM conversations c JOIN firsts f USING (conv_id)
           WHERE c.role = 'assistant')
, req AS (SELECT conv_id, count(*) FILTER (WHERE code IS NOT NULL AND code <> 'Openai timed out') AS n_ok,
    any_value(template) AS template FROM comp GROUP BY conv_id)
, x AS (SELECT comp.conv_id, comp.turn, (comp.code IS NULL OR comp.code = 'Openai timed out') AS failed,
    {ntok('req.template')} AS template_len, req.n_ok,
    CASE WHEN comp.code IS NULL OR comp.code = 'Openai timed out' THEN 0 ELSE {ntok('comp.code')} END AS generation_len
    FROM comp JOIN req USING (conv_id))
SELECT conv_id, turn, template_len, generation_len,
  {fin(f'CASE WHEN failed THEN 0.0 ELSE CAST(generation_len AS DOUBLE) * CAST({au.COMPLETION_RATE_PER_1K} AS DOUBLE) / 1000.0 + CASE WHEN n_ok > 0 THEN (CAST(template_len AS DOUBLE) * CAST({au.PROMPT_RATE_PER_1K} AS DOUBLE) / 1000.0) / n_ok ELSE 0.0 END END')} AS total_cost
FROM x""")
def a16_cost_report(spark, sf):
    conv = table(spark, sf, "conversations")
    firsts = au.keep_first(conv.select("conv_id", "turn", "text"), ["conv_id"], ["turn"]).select(
        "conv_id", F.col("text").alias("template"))
    comp = (conv.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("code"))
            .join(firsts, "conv_id"))
    return au.cost_report(comp, request="conv_id").select(
        "conv_id", "turn", "template_len", "generation_len", "total_cost")


@query("a16_cost_summary", f"""
, firsts AS (SELECT conv_id, arg_min(text, turn) AS template FROM conversations GROUP BY conv_id)
, comp AS (SELECT c.conv_id, c.text AS code, f.template FROM conversations c JOIN firsts f USING (conv_id)
           WHERE c.role = 'assistant')
, req AS (SELECT conv_id, count(*) AS n_ok FROM comp GROUP BY conv_id)
, x AS (SELECT {ntok('template')} AS template_len, {ntok('code')} AS generation_len, n_ok
        FROM comp JOIN req USING (conv_id))
SELECT {fin(f'sum(generation_len * {au.COMPLETION_RATE_PER_1K} / 1000.0 + template_len * {au.PROMPT_RATE_PER_1K} / 1000.0 / n_ok)')} AS total_cost,
  {fin('avg(template_len)')} AS avg_template_len, {fin('avg(generation_len)')} AS avg_generation_len FROM x""")
def a16_cost_summary(spark, sf):
    return au.cost_summary(a16_cost_report(spark, sf))


@query("f14_drop_failed_completions", oracle_with(["v_generations"], """
SELECT src_id, CAST(gen_idx AS BIGINT) AS gen_idx, (code IS NULL OR code = 'Openai timed out') AS failed
FROM v_generations"""))
def f14_drop_failed_completions(spark, sf):
    return au.drop_failed_completions(view(spark, sf, "v_generations")).select("src_id", "gen_idx", "failed")


@query("f15_projected_cost", f"""
, d AS (SELECT lang, count(*) AS n, avg({ntok('text')}) AS p, avg(n_chars) AS a FROM documents GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n_calls,
  {fin(f'n * (p * {au.PROMPT_RATE_PER_1K} + a * {au.COMPLETION_RATE_PER_1K} * 5) / 1000.0')} AS projected_cost FROM d""")
def f15_projected_cost(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.avg(tx.token_length(F.col("text"))).alias("prompt_tokens"),
        F.avg("n_chars").alias("answer_tokens"))
    return au.projected_cost(d.withColumn("answers_per_call", F.lit(5))).select("lang", "n_calls", "projected_cost")


def _f5_sql() -> str:
    from pairlab.plans.registry import sql_str
    newline = "chr(10) || '+'"

    def code(x):
        return f"coalesce(regexp_replace({x}, {newline}, chr(10), 'g'), '')"

    def desc(x):
        return f"coalesce(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), chr(10) || '{{2,}}', chr(10) || chr(10), 'g'), '')"
    cut, pieces = au.CODE_ONLY_TEMPLATE, []
    for slot, value in (("Description 1", desc("q.html")), ("Code 1", code("q.url")), ("Description 2", desc("c.html")), ("Code 2", code("c.url"))):
        before, cut = cut.split(f"{slot}: ...", 1)
        pieces += [sql_str(f"{before}{slot}: "), value, "chr(10) || chr(10)"]
    prompt = " || ".join([*pieces, sql_str(cut)])
    return _j6_sql(seed=7, max_len=700, draws=25).replace(
        "SELECT p.problem_id AS candidate_id, CAST(f.draw AS BIGINT) AS draw, f.partner_id\nFROM prob2 p LEFT JOIN first f ON f.candidate_id = p.problem_id",
        f"""SELECT candidate_id, partner_id, CAST(length(x) AS BIGINT) AS prompt_length, sha256(x) AS prompt_hash
FROM (SELECT c.page_id AS candidate_id, f.partner_id, CASE WHEN f.partner_id IS NOT NULL THEN {prompt} END AS x
      FROM pages c LEFT JOIN first f ON f.candidate_id = c.page_id LEFT JOIN pages q ON q.page_id = f.partner_id)""")


@query("f5_fill_prompt_slots", _f5_sql())
def f5_fill_prompt_slots(spark, sf):
    """Every candidate; one without a partner has no prompt."""
    p = _problems(spark, sf)
    pairs = au.sample_context_pairs(p, p, max_len=700, draws=25, seed=7)
    pages = table(spark, sf, "pages")
    c = pages.select(F.col("page_id").alias("candidate_id"), F.col("url").alias("cand_code"),
                     F.col("html").alias("cand_desc"))
    q = pages.select(F.col("page_id").alias("partner_id"), F.col("url").alias("partner_code"),
                     F.col("html").alias("partner_desc"))
    d = au.fill_prompt_slots(pairs.join(c, "candidate_id").join(q, "partner_id", "left"))
    return d.select("candidate_id", "partner_id", F.length("prompt").alias("prompt_length"),
                    F.sha2("prompt", 256).alias("prompt_hash"))


@query("select_novel_survivors", oracle_with(["v_outputs"], _TOP20 + """
, novel AS (SELECT cands.problem_id, cands.program_id FROM cands LEFT JOIN nm ON nm.problem_id = cands.problem_id AND nm.cand = cands.program_id
            WHERE runs_all AND coalesce(nm.n_matching, 0) = 0)
, nov_out AS (SELECT o.* FROM v_outputs o JOIN novel USING (problem_id, program_id) WHERE kind = 'candidate')
, sig AS (SELECT program_id, string_agg(problem_id || ':' || tc_no || ':' || output, '|' ORDER BY problem_id, tc_no) AS s
          FROM nov_out GROUP BY program_id)
, grp AS (SELECT s, count(*) AS m, min(program_id) AS cluster_id FROM sig GROUP BY s)
SELECT cluster_id AS program_id, 'generated_' || CAST(row_number() OVER (ORDER BY cluster_id) - 1 AS VARCHAR) AS gen_id,
  CAST(m AS BIGINT) AS n_equivalent FROM grp"""))
def select_novel_survivors(spark, sf):
    from pairlab.plans.jobs import select_novel
    return select_novel(view(spark, sf, "v_outputs"))["survivors"].select("program_id", "gen_id", "n_equivalent")


@query("mine_seeds_job", oracle_with(["v_submissions"], _SEEDS + """
SELECT s.problem_id, s.submission_id, CAST(s.num_submissions AS BIGINT) AS num_submissions,
  p.page_id IS NOT NULL AS has_description
FROM seeds s LEFT JOIN pages p ON p.page_id = s.problem_id
ORDER BY s.n_accepted DESC, s.problem_id LIMIT 10"""))
def mine_seeds_job(spark, sf):
    from pairlab.plans.jobs import mine_seeds
    desc = table(spark, sf, "pages").select(F.col("page_id").alias("problem_id"),
                                            F.lit(True).alias("has_description"))
    out = mine_seeds(view(spark, sf, "v_submissions"), descriptions=desc, n=10, mode="top")
    return out.select("problem_id", "submission_id", "num_submissions",
                      F.coalesce("has_description", F.lit(False)).alias("has_description"))
