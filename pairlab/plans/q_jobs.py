"""Checked queries for text jobs, checks in plans, general co-location, version comparison and the composed jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.operators import augment as au
from pairlab.operators import checks as ck
from pairlab.operators import evaluate as ev
from pairlab.operators import prepare as pp
from pairlab.operators import reshape as rs
from pairlab.operators import retrieve as rt
from pairlab.operators import runs as rn
from pairlab.operators import texts
from pairlab.operators.nearest import knn_join_pivots
from pairlab.plans import jobs
from pairlab.plans.fixtures import oracle_with, table, view
from pairlab.plans.q_augment import _PASS, ntok
from pairlab.plans.q_evaluate import _shares_sql
from pairlab.plans.q_prepare import _PAIRS_TAGGED, _answer_lists, _prompt_sql
from pairlab.plans.registry import INF_SQL, fin, floor1, query, sdiv, sql_str
from pairlab.session import checkpoint_dir
from pairlab.sources import io

# ---- F2 by blocks ------------------------------------------------------------

_ESC = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("f2_block_text", """
SELECT conv_id, turn, sha256(role || chr(10) || chr(10) || trim(regexp_replace(text || ' bold link', '[ \\t\\n\\r\\f]+', ' ', 'g')) || chr(10) || chr(10) ||
  'one' || chr(10) || CAST(turn AS VARCHAR) || chr(10) || chr(10) || 'a b' || chr(10) || 'c' || chr(10) || chr(10) || 'x  y' || chr(10) || ' z' || chr(10) || chr(10) || 'tail') AS text_hash
FROM conversations""")
def f2_block_text(spark, sf):
    """Pages made of turns, whose text is known: headings, paragraphs, lists, tables, code, links, images, scripts."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><head><title>t</title><style>p{}</style></head><body>\n <h1>"), esc(F.col("role")), F.lit("</h1>\n<p>"), esc(F.col("text")),
                    F.lit(" <b>bold</b>\n<a href='x' name='y'>link</a><img src='i.png'></p><ul> <li>one</li><li>"), F.col("turn").cast("string"),
                    F.lit("</li></ul><table><tr><td>a</td><td> b</td></tr><tr><td>c</td></tr></table><pre>x  y\n z</pre><script>x<y</script>\n<div>tail</div></body></html>"))
    pages = table(spark, sf, "conversations").select("conv_id", "turn", html.alias("html"))
    d = texts.pages_to_text(pages, out="text").rows
    return d.select("conv_id", "turn", F.sha2("text", 256).alias("text_hash"))


@query("f2_block_text_pages")
def f2_block_text_pages(spark, sf):
    """Every page's text, by blocks."""
    return texts.pages_to_text(table(spark, sf, "pages").select("page_id", "html"), out="text_description").rows.select("page_id", "text_description")


# ---- F12 ---------------------------------------------------------------------

def _ngrams_sql(dims: int = 64, n: int = 3) -> str:
    h = "CAST('0x' || substr(md5(substr(t, i, 3)), 1, 8) AS BIGINT)"
    return f"""
WITH u AS (SELECT DISTINCT lower(text) AS t FROM documents)
, g AS (SELECT t, {h} AS h FROM u, unnest(range(1, greatest(length(t) - {n - 2}, 1))) AS x(i))
, s AS (SELECT t, h % {dims} AS b, CAST(sum(CASE WHEN (h // {dims}) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS s FROM g GROUP BY ALL)
, v AS (SELECT u.t, string_agg(CAST(coalesce(s.s, 0) AS VARCHAR), ',' ORDER BY b.b) AS vector FROM u, unnest(range({dims})) AS b(b) LEFT JOIN s ON s.t = u.t AND s.b = b.b GROUP BY u.t)
SELECT doc_id, vector FROM documents JOIN v ON lower(text) = v.t"""


def _vector(c: str):
    return F.array_join(F.col(c).cast("array<bigint>").cast("array<string>"), ",")


@query("f12_encode_text_ngrams", _ngrams_sql())
def f12_encode_text_ngrams(spark, sf):
    """Signed hashing of character trigrams."""
    d = rt.encode_text(table(spark, sf, "documents"), "text", method="ngrams")
    return d.select("doc_id", _vector("embedding").alias("vector"))


def letter_matrix(batch):
    """An encoder as a user plugs one in: letters of each text, counted outside Spark's expressions."""
    import numpy as np
    return np.array([[t.lower().count(x) for x in rt.LETTERS] for t in batch], dtype="float64")


def _f12_encoder_sql() -> str:
    from pairlab.plans.q_retrieve import letters_sql
    return f"""
SELECT doc_id, array_to_string(list_transform({letters_sql('text')}, lambda x: CAST(x AS BIGINT)), ',') AS vector FROM documents"""


@query("f12_encode_text_encoder", _f12_encoder_sql())
def f12_encode_text_encoder(spark, sf):
    """A pluggable encoder: every distinct text once, in batches."""
    d = rt.encode_text(table(spark, sf, "documents"), "text", encoder=letter_matrix)
    return d.select("doc_id", _vector("embedding").alias("vector"))


# ---- J7 with pivots ------------------------------------------------------------

def _knn_sql(v: str, k: int) -> str:
    return f"""
WITH e AS (SELECT vec_id, {v} AS v FROM embeddings)
, d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS dist
  FROM e a JOIN e b ON a.vec_id <> b.vec_id)
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS rank FROM d)
, near AS (SELECT query_id, neighbor_id, CAST(rank AS BIGINT) AS rank, {fin('dist')} AS dist FROM r WHERE rank <= {k})
"""


def _own_vectors(spark, sf, vector):
    e = table(spark, sf, "embeddings").select("vec_id", vector.alias("embedding"))
    return e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "neighbor_id")


@query("j7_knn_join_pivots", _knn_sql("CAST(embedding AS DOUBLE[])", 4) + "SELECT query_id, neighbor_id, rank, dist FROM near")
def j7_knn_join_pivots(spark, sf):
    q, c = _own_vectors(spark, sf, F.col("embedding").cast("array<double>"))
    return knn_join_pivots(q, c, k=4, qkey="query_id", ckey="neighbor_id").rows.select("query_id", "neighbor_id", "rank", "dist")


# vectors around a few far centres, given by their label and the number of their row
_CLUSTERED = "list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) / 64) || [CAST(label AS DOUBLE), CAST(vec_id % 10 AS DOUBLE)]"


def _clustered():
    near = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 8), lambda x: x / 64)
    return F.concat(near, F.array(F.col("label").cast("double"), (F.col("vec_id") % 10).cast("double")))


@query("j7_knn_pivots_clustered", _knn_sql(_CLUSTERED, 3) + "SELECT query_id, neighbor_id, rank, dist FROM near")
def j7_knn_pivots_clustered(spark, sf):
    """Clustered vectors, where the bounds leave most blocks out."""
    q, c = _own_vectors(spark, sf, _clustered())
    return knn_join_pivots(q, c, k=3, qkey="query_id", ckey="neighbor_id", block_rows=32).rows.select("query_id", "neighbor_id", "rank", "dist")


@query("j7_knn_pivots_work", """
SELECT CAST(count(*) * count(*) AS BIGINT) AS n_all_distances, count(*) >= 500 AS is_pruned FROM embeddings""")
def j7_knn_pivots_work(spark, sf):
    """Distances computed on the clustered vectors: fewer than half of all, pivots included, once there are enough rows."""
    q, c = _own_vectors(spark, sf, _clustered())
    r = knn_join_pivots(q, c, k=3, qkey="query_id", ckey="neighbor_id", block_rows=32).report()
    less = (F.col("n_row_distances") + F.col("n_pivot_distances")) * 2 < F.col("n_all_distances")
    return r.select("n_all_distances", (less & (F.col("n_all_distances") >= 250_000)).alias("is_pruned"))


# ---- A10 / A11 in general -------------------------------------------------------

# programs that miss tests, and some with two outputs of a test
_IRREGULAR = """
, irr AS (SELECT problem_id, tc_no, program_id, output FROM v_outputs WHERE NOT (program_id % 7 = 3 AND tc_no % 3 = program_id % 3) AND NOT (program_id % 50 = 1 AND tc_no > 2)
          UNION ALL SELECT problem_id, tc_no, program_id, 'again' FROM v_outputs WHERE program_id % 9 = 2 AND tc_no = 5)
, grp AS (SELECT DISTINCT problem_id, tc_no, output, program_id FROM irr)
, cnt AS (SELECT program_id, count(*) AS n FROM grp GROUP BY program_id)
, com AS (SELECT a.program_id AS a, b.program_id AS b, count(*) AS n FROM grp a JOIN grp b USING (problem_id, tc_no, output) GROUP BY ALL)
, con AS (SELECT com.a, com.b FROM com JOIN cnt ON cnt.program_id = com.a WHERE com.n = cnt.n)
, own AS (SELECT a, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS s, count(*) AS n, max(b) AS hi, sum(b) AS total FROM con GROUP BY a)
, sets AS (SELECT min(a) AS class_id, any_value(n) AS n_programs, any_value(hi) AS max_program, any_value(total) AS sum_program FROM own WHERE n > 1 GROUP BY s)
"""


def _irregular(spark, sf):
    p, t = F.col("program_id"), F.col("tc_no")
    o = view(spark, sf, "v_outputs")
    kept = o.filter(~((p % 7 == 3) & (t % 3 == p % 3)) & ~((p % 50 == 1) & (t > 2)))
    return kept.unionByName(o.filter((p % 9 == 2) & (t == 5)).withColumn("output", F.lit("again")))


@query("a10_co_location_general", oracle_with(["v_outputs"], _IRREGULAR + """
SELECT class_id, CAST(n_programs AS BIGINT) AS n_programs, max_program, CAST(sum_program AS BIGINT) AS sum_program FROM sets"""))
def a10_co_location_general(spark, sf):
    """Sets by containment, against counts of all pairs of programs."""
    found = au.co_location(_irregular(spark, sf))
    sizes = found["members"].groupBy("class_id").agg(F.max("program_id").alias("hi"), F.sum("program_id").alias("total"))
    inside = found["sets"].select("class_id", F.col("class_id").alias("other_id")).unionByName(
        found["links"].select("class_id", "other_id").join(found["sets"].select("class_id"), "class_id", "left_semi"))
    spread = inside.join(sizes.withColumnRenamed("class_id", "other_id"), "other_id").groupBy("class_id").agg(
        F.max("hi").alias("max_program"), F.sum("total").alias("sum_program"))
    return found["sets"].join(spread, "class_id").select("class_id", "n_programs", "max_program", "sum_program")


@query("a11_unique_program_count_general", oracle_with(["v_outputs"], _IRREGULAR + f"""
, inside AS (SELECT DISTINCT con.b FROM con JOIN own USING (a) WHERE own.n > 1)
, x AS (SELECT (SELECT count(*) FROM cnt) AS total, (SELECT count(*) FROM inside) AS ins, (SELECT count(*) FROM sets) AS n_sets)
SELECT CAST(total - ins + n_sets AS BIGINT) AS unique_programs, CAST(total AS BIGINT) AS total_programs, {fin('100.0 * (total - ins + n_sets) / total')} AS percent_unique,
  CAST(n_sets AS BIGINT) AS n_sets FROM x"""))
def a11_unique_program_count_general(spark, sf):
    return au.unique_program_count_general(_irregular(spark, sf))


# ---- checks in plans --------------------------------------------------------------

def _counts(spark, checked: ck.Checked, action=None):
    """The counts of one pass over a checked plan, as a row."""
    counts = checked.write(f"{checkpoint_dir(spark)}/checked/{uuid.uuid4().hex}")
    return spark.createDataFrame([tuple(counts.values())], T.StructType([T.StructField(n, T.LongType()) for n in counts]))


@query("p1_checked", oracle_with(["v_pairs"], """
SELECT CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(*) FILTER (WHERE src_id % 6 = 2) AS BIGINT) AS n_identical FROM v_pairs"""))
def p1_checked(spark, sf):
    """Identical pairs are counted in the pass that drops them."""
    p = view(spark, sf, "v_pairs").withColumn("src_code", F.when(F.col("src_id") % 6 == 2, F.col("tgt_code")).otherwise(F.concat(F.lit("x"), "src_code")))
    return _counts(spark, ck.drop_identity_pairs(p))


@query("p2_checked", oracle_with(["v_generations"], """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE code IS NULL) AS BIGINT) AS n_null,
  CAST(count(*) FILTER (WHERE code IS NOT NULL AND src_id % 5 = 1) AS BIGINT) AS n_empty FROM v_generations"""))
def p2_checked(spark, sf):
    g = view(spark, sf, "v_generations").withColumn("code", F.when(F.col("code").isNotNull() & (F.col("src_id") % 5 == 1), F.lit("")).otherwise(F.col("code")))
    return _counts(spark, ck.clean_code_rows(g))


@query("f14_checked", """
SELECT CAST(count(*) AS BIGINT) AS n_completions, CAST(count(*) FILTER (WHERE (conv_id + turn) % 4 = 1 OR conv_id % 7 = 2) AS BIGINT) AS n_failed FROM conversations""")
def f14_checked(spark, sf):
    return _counts(spark, ck.drop_failed_completions(_failing(spark, sf), most_failed=0.9))


@query("j1_checked", oracle_with(["v_generations", "v_inputs"], """
, f AS (SELECT DISTINCT src_id FROM v_generations WHERE src_id % 3 <> 1)
SELECT CAST(count(*) AS BIGINT) AS n_reference, CAST(count(f.src_id) AS BIGINT) AS n_found, CAST(count(*) - count(f.src_id) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_unknown
FROM v_inputs LEFT JOIN f USING (src_id)"""))
def j1_checked(spark, sf):
    """Row arithmetic of the completion, counted while it runs."""
    g = view(spark, sf, "v_generations").filter("src_id % 3 <> 1")
    return _counts(spark, ck.complete_with_missing(g, view(spark, sf, "v_inputs"), key=["src_id"],
                                                   fill={"gen_idx": 0, "accuracy": 0.0, "agg_runtime": float("inf"), "code": None}))


@query("a10_once_per_test", oracle_with(["v_outputs"], """
SELECT program_id, CAST(count(*) AS BIGINT) AS n FROM v_outputs GROUP BY program_id"""))
def a10_once_per_test(spark, sf):
    """Outputs that pass the check on signatures' condition."""
    return ck.once_per_test(view(spark, sf, "v_outputs")).groupBy("program_id").agg(F.count("output").alias("n"))


# ---- J9 in full, A2 / P7 with maps ---------------------------------------------------

_VERSIONS = """
, nn AS (SELECT submission_id, tc, count(*) AS n FROM v_repeats GROUP BY ALL)
, vr AS (SELECT r.submission_id, r.tc, CASE WHEN r.rep * 2 < nn.n THEN 'v0' ELSE 'v1' END AS version, r.rep, r.t FROM v_repeats r JOIN nn USING (submission_id, tc)
         WHERE NOT (r.submission_id % 6 = 5 AND r.rep * 2 >= nn.n))
, vs AS (SELECT submission_id, tc, version, row_number() OVER (PARTITION BY submission_id, tc, version ORDER BY rep) - 1 AS rep,
           CASE WHEN NOT (submission_id % 9 = 4 AND tc = 'click' AND version = 'v1') THEN t END AS t FROM vr)
, run AS (SELECT submission_id, version, tc AS tc_no, tc <> 'error' OR submission_id % 4 <> 0 AS success, sum(t) AS t FROM vs GROUP BY submission_id, version, tc)
, acc AS (SELECT submission_id, version, tc_no, CASE WHEN submission_id % 8 = 3 THEN 0.5 ELSE 1.0 END AS accuracy FROM run)
, comp AS (SELECT DISTINCT submission_id, version, NOT (submission_id % 11 = 7 AND version = 'v1') AS compiled FROM run)
"""


def _versions(spark, sf):
    r = view(spark, sf, "v_repeats")
    n = r.groupBy("submission_id", "tc").agg(F.count(F.lit(1)).alias("n"))
    late = F.col("rep") * 2 >= F.col("n")
    from pyspark.sql import Window
    vr = r.join(n, ["submission_id", "tc"]).filter(~((F.col("submission_id") % 6 == 5) & late)).withColumn("version", F.when(late, "v1").otherwise("v0"))
    w = Window.partitionBy("submission_id", "tc", "version").orderBy("rep")
    broken = (F.col("submission_id") % 9 == 4) & (F.col("tc") == "click") & (F.col("version") == "v1")
    vs = vr.withColumn("rep", F.row_number().over(w) - 1).withColumn("t", F.when(~broken, F.col("t"))).select("submission_id", "tc", "version", "rep", "t")
    success = (F.col("tc_no") != "error") | (F.col("submission_id") % 4 != 0)
    run = vs.groupBy("submission_id", "version", F.col("tc").alias("tc_no")).agg(F.sum("t").alias("t")).withColumn("success", success)
    acc = run.select("submission_id", "version", "tc_no", F.when(F.col("submission_id") % 8 == 3, 0.5).otherwise(1.0).alias("accuracy"))
    comp = run.select("submission_id", "version", (~((F.col("submission_id") % 11 == 7) & (F.col("version") == "v1"))).alias("compiled")).distinct()
    return vs.withColumnRenamed("tc", "tc_no"), run, acc, comp


def _compare_sql(together: bool) -> str:
    cut = "least(a.own, e.every)" if together else "a.own"
    bad = "NOT coalesce(compiled, false) OR coalesce(mean_acc < 0.95, true)"
    side = lambda name, v: f"max({name}) FILTER (WHERE version = '{v}')"
    rt = lambda name, v: f"coalesce({side(name, v)}, {INF_SQL})"
    cols = []
    for v in ("v0", "v1"):
        cols += [f"{fin(rt('rt', v))} AS agg_runtime_{v}", f"CAST(coalesce({side('n_tests', v)}, 0) AS BIGINT) AS n_tests_{v}",
                 f"CAST(coalesce({side('n_success', v)}, 0) AS BIGINT) AS n_success_{v}", f"{fin(rt('bm', v))} AS agg_runtime_binary_{v}",
                 f"{fin(rt('bs', v))} AS agg_stdev_binary_{v}", f"{fin(side('mean_acc', v))} AS mean_acc_{v}",
                 f"coalesce(bool_or(compiled) FILTER (WHERE version = '{v}'), false) AS compilation_{v}",
                 f"coalesce(bool_or(gated) FILTER (WHERE version = '{v}'), true) AS gated_{v}"]
    return oracle_with(["v_repeats"], _VERSIONS + f"""
, pt AS (SELECT submission_id, version, tc, count(t) AS n, count(*) - count(t) AS nulls FROM vs GROUP BY ALL)
, own AS (SELECT submission_id, version, min(n) AS own, max(nulls) AS nulls FROM pt GROUP BY ALL)
, every AS (SELECT submission_id, min(own) AS every FROM own GROUP BY ALL)
, sh AS (SELECT a.submission_id, a.version, a.nulls, {cut} AS short FROM own a JOIN every e USING (submission_id))
, su AS (SELECT vs.submission_id, vs.version, vs.rep, sum(vs.t) AS t FROM vs JOIN sh USING (submission_id, version) WHERE vs.rep < sh.short GROUP BY ALL)
, st AS (SELECT submission_id, version, avg(t) AS m, stddev_pop(t) AS s FROM su GROUP BY ALL)
, b AS (SELECT sh.submission_id, sh.version, CASE WHEN nulls > 0 OR short = 0 THEN {INF_SQL} ELSE m END AS bm, CASE WHEN nulls > 0 OR short = 0 THEN {INF_SQL} ELSE s END AS bs
        FROM sh LEFT JOIN st USING (submission_id, version))
, r AS (SELECT submission_id, version, sum(CASE WHEN success AND t IS NOT NULL THEN t ELSE {INF_SQL} END) AS rt, count(*) AS n_tests, count(*) FILTER (WHERE success) AS n_success FROM run GROUP BY ALL)
, m AS (SELECT submission_id, version, avg(accuracy) AS mean_acc FROM acc GROUP BY ALL)
, j AS (SELECT r.submission_id, r.version, rt, n_tests, n_success, bm, bs, compiled, CASE WHEN compiled THEN mean_acc ELSE 0.0 END AS mean_acc
        FROM r JOIN b USING (submission_id, version) JOIN m USING (submission_id, version) JOIN comp USING (submission_id, version))
, l AS (SELECT submission_id, version, n_tests, n_success, compiled, mean_acc, coalesce(mean_acc < 0.95, true) AS gated, CASE WHEN {bad} THEN {INF_SQL} ELSE rt END AS rt,
          CASE WHEN {bad} THEN {INF_SQL} ELSE bm END AS bm, CASE WHEN {bad} THEN {INF_SQL} ELSE bs END AS bs FROM j)
SELECT submission_id, {', '.join(cols)}, {fin(sdiv(rt('rt', 'v0'), rt('rt', 'v1')))} AS speedup, {fin(sdiv(rt('bm', 'v0'), rt('bm', 'v1')))} AS speedup_binary
FROM l GROUP BY submission_id""")


_COMPARED = [f"{c}_{v}" for v in ("v0", "v1") for c in ("agg_runtime", "n_tests", "n_success", "agg_runtime_binary", "agg_stdev_binary", "mean_acc", "compilation", "gated")]


def _compared(spark, sf, together: bool):
    repeats, run, acc, comp = _versions(spark, sf)
    d = rn.compare_versions(run, repeats=repeats, accuracy=acc, compilation=comp, together=together, threshold=0.95)
    return d.select("submission_id", *_COMPARED, "speedup", "speedup_binary")


@query("j9_compare_versions", _compare_sql(False))
def j9_compare_versions(spark, sf):
    """Two versions in full: lost versions, repeats without a time, versions that do not compile or miss the gate."""
    return _compared(spark, sf, False)


@query("j9_compare_versions_together", _compare_sql(True))
def j9_compare_versions_together(spark, sf):
    """The same, both versions cut to the shortest of all their tests."""
    return _compared(spark, sf, True)


def _entries(m: str):
    """A map's entries in order of key, infinities as null."""
    value = lambda x: F.when(F.abs(x["value"]) < float("inf"), F.round(x["value"], 6).cast("decimal(30,6)").cast("string")).otherwise("null")
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"].cast("string"), F.lit("="), value(x))), ",")


_MAP = "string_agg(tc_no || '=' || CASE WHEN {ok} THEN CAST(CAST({t} AS DECIMAL(30,6)) AS VARCHAR) ELSE 'null' END, ',' ORDER BY tc_no)"


@query("a2_total_runtime_maps", oracle_with(["v_repeats"], _VERSIONS + f"""
SELECT submission_id, version, CAST(count(*) AS BIGINT) AS n_tests, {_MAP.format(ok='success AND t IS NOT NULL', t='t')} AS times,
  string_agg(tc_no || '=' || success, ',' ORDER BY tc_no) AS successes FROM run GROUP BY submission_id, version"""))
def a2_total_runtime_maps(spark, sf):
    """Per-test maps of times and successes."""
    run = _versions(spark, sf)[1]
    d = rn.total_runtime(run, key=["submission_id", "version"], map_limit=100)
    ok = F.array_join(F.transform(F.array_sort(F.map_entries("tc2success")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return d.select("submission_id", "version", "n_tests", _entries("tc2time").alias("times"), ok.alias("successes"))


@query("p7_pivot_results_maps", oracle_with(["v_repeats"], _VERSIONS + f"""
, m AS (SELECT submission_id, version, {_MAP.format(ok='success AND t IS NOT NULL', t='t + CASE WHEN submission_id % 3 = 0 THEN 1 ELSE 0 END')} AS times FROM run GROUP BY submission_id, version)
SELECT submission_id, max(times) FILTER (WHERE version = 'v0') AS v0_times, max(times) FILTER (WHERE version = 'v1') AS v1_times FROM m GROUP BY submission_id"""))
def p7_pivot_results_maps(spark, sf):
    """Maps pivoted (some measured twice: the last counts), written as JSON lines without infinities, and read back."""
    run = _versions(spark, sf)[1]
    once = rn.total_runtime(run, key=["submission_id", "version"], map_limit=100).select("submission_id", "version", "tc2time", F.lit(0).alias("seq"))
    again = once.filter("submission_id % 3 = 0").withColumn("tc2time", F.transform_values("tc2time", lambda _, v: v + 1)).withColumn("seq", F.lit(1))
    wide = rs.pivot_results(again.unionByName(once), key="submission_id", types=["v0", "v1"], values=["tc2time"], type_col="version", order="seq")
    path = f"{checkpoint_dir(spark)}/records/{uuid.uuid4().hex}"
    io.write_records(wide, path, inf_as_null=True)
    maps = T.MapType(T.StringType(), T.DoubleType())
    back = io.read_records(spark, path, T.StructType([T.StructField("submission_id", T.LongType()), T.StructField("v0_tc2time", maps), T.StructField("v1_tc2time", maps)]))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(
        F.round(x["value"], 6).cast("decimal(30,6)").cast("string"), F.lit("null")))), ",")
    return back.select("submission_id", text("v0_tc2time").alias("v0_times"), text("v1_tc2time").alias("v1_times"))


# ---- F5 second step, failed completions, cost ------------------------------------------

def _failing(spark, sf):
    """Completions of which some timed out and some are missing."""
    c, t = F.col("conv_id"), F.col("turn")
    code = F.when((c + t) % 4 == 1, F.lit(au.FAILED_COMPLETION)).when(c % 7 != 2, F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", code.alias("code"))


_FAILING = """
, fl AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 4 = 1 THEN 'Openai timed out' WHEN conv_id % 7 <> 2 THEN text END AS code FROM conversations)
"""


@query("f5_continue_prompts", _FAILING + f"""
, st AS (SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user')
, de AS (SELECT conv_id, turn - 1 AS turn, code AS description FROM fl WHERE role = 'assistant')
SELECT st.conv_id, st.turn, coalesce(description IS NULL OR description = 'Openai timed out', true) AS failed,
  CASE WHEN description IS NOT NULL AND description <> 'Openai timed out' THEN sha256(prompt || description || chr(10) || chr(10) || {sql_str(au.CODE_DESCRIPTION_PAIR_END_TEMPLATE)} || chr(10) || chr(10)) END AS prompt_hash
FROM st LEFT JOIN de USING (conv_id, turn)""")
def f5_continue_prompts(spark, sf):
    """Each user turn as a first prompt, the next turn as its completion (some failed, some missing)."""
    steps = table(spark, sf, "conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("request_id"), F.col("text").alias("prompt"))
    done = _failing(spark, sf).filter("role = 'assistant'").select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("request_id"), F.col("code").alias("description"))
    d = au.continue_prompts(steps, done)
    return d.select("request_id.conv_id", "request_id.turn", "failed", F.sha2("next_prompt", 256).alias("prompt_hash"))


def _pair_template_sql() -> str:
    cut, pieces = au.CODE_DESCRIPTION_PAIR_START_TEMPLATE, []
    one = "regexp_replace(src_code, chr(10) || '+', chr(10), 'g')"
    two = "regexp_replace(regexp_replace(tgt_code, '<[^>]*>', '', 'g'), chr(10) || '{2,}', chr(10) || chr(10), 'g')"
    for slot, value in (("Description 1", two), ("Code 1", one), ("Description 2", two), ("Code 2", one)):
        before, cut = cut.split(f"{slot}: ...", 1)
        pieces += [sql_str(f"{before}{slot}: "), value, "chr(10) || chr(10)"]
    return oracle_with(["v_pairs"], f"SELECT src_id, sha256({' || '.join([*pieces, sql_str(cut)])}) AS prompt_hash FROM v_pairs")


@query("f5_pair_prompts", _pair_template_sql())
def f5_pair_prompts(spark, sf):
    """The description-first template, its four slots filled."""
    p = view(spark, sf, "v_pairs")
    d = au.fill_prompt_slots(p, au.CODE_DESCRIPTION_PAIR_START_TEMPLATE,
                             slots={"Code 1": "src_code", "Code 2": "src_code", "Description 1": "tgt_code", "Description 2": "tgt_code"})
    return d.select("src_id", F.sha2("prompt", 256).alias("prompt_hash"))


_COSTS = _FAILING + f"""
, firsts AS (SELECT conv_id, arg_min(text, turn) AS template FROM conversations GROUP BY conv_id)
, req AS (SELECT conv_id, count(*) FILTER (WHERE code IS NOT NULL AND code <> 'Openai timed out') AS n_ok FROM fl GROUP BY conv_id)
, x AS (SELECT fl.conv_id, fl.turn, code IS NULL OR code = 'Openai timed out' AS failed, {ntok('template')} AS template_len, n_ok,
    CASE WHEN code IS NULL OR code = 'Openai timed out' THEN 0 ELSE {ntok('code')} END AS generation_len FROM fl JOIN req USING (conv_id) JOIN firsts USING (conv_id))
, y AS (SELECT conv_id, turn, failed, template_len, generation_len, CASE WHEN failed THEN 0.0 ELSE CAST(generation_len AS DOUBLE) * CAST({au.COMPLETION_RATE_PER_1K} AS DOUBLE) / 1000.0
    + (CAST(template_len AS DOUBLE) * CAST({au.PROMPT_RATE_PER_1K} AS DOUBLE) / 1000.0) / n_ok END AS total_cost FROM x)
"""


def _failing_requests(spark, sf):
    conv = table(spark, sf, "conversations")
    firsts = au.keep_first(conv.select("conv_id", "turn", "text"), ["conv_id"], ["turn"]).select("conv_id", F.col("text").alias("template"))
    return _failing(spark, sf).join(firsts, "conv_id")


@query("a16_cost_report_failures", _COSTS + f"""
SELECT conv_id, turn, failed, template_len, generation_len, {fin('total_cost')} AS total_cost FROM y""")
def a16_cost_report_failures(spark, sf):
    """Requests of which some, or all, completions failed."""
    return au.cost_report(_failing_requests(spark, sf), request="conv_id").select("conv_id", "turn", "failed", "template_len", "generation_len", "total_cost")


# ---- S6 with stats ---------------------------------------------------------------------

@query("s6_parse_run_stats_planted", f"""
WITH e AS (SELECT user_id AS run_id, count(*) AS n, sum(event_id) AS s FROM events GROUP BY user_id)
, p AS (SELECT run_id, 'sim_ticks' AS stat, 1 AS n_values, CAST(s AS DOUBLE) AS first_value FROM e
  UNION ALL SELECT run_id, 'sim_freq', 1, CAST(CASE WHEN run_id % 10 = 3 THEN 0 ELSE 1000 END AS DOUBLE) FROM e WHERE run_id % 10 <> 7
  UNION ALL SELECT run_id, 'system.cpu.ipc', 3, n / 4 FROM e UNION ALL SELECT run_id, 'host.mem', 2, NULL FROM e
  UNION ALL SELECT run_id, 'sim_seconds_precise', 1, CASE WHEN run_id % 10 = 7 THEN NULL WHEN run_id % 10 = 3 THEN NULL ELSE s / 1000 END FROM e)
SELECT run_id, stat, CAST(n_values AS BIGINT) AS n_values, {fin('first_value')} AS first_value FROM p""")
def s6_parse_run_stats_planted(spark, sf):
    """Stats files of every user: comments, percents, markers, blank lines, nan, a missing and a zero frequency, repeated keys."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    r = F.col("run_id") % 10
    freq = F.when(r == 7, F.lit("# no sim_freq 5")).when(r == 3, F.lit("sim_freq  0 # Hz")).otherwise(F.lit("sim_freq\t1000 # Hz"))
    lines = F.array(F.lit("---------- Begin Simulation Statistics ----------"), F.lit("sim_ticks 5 # an earlier dump"), F.lit("  "),
                    text("sim_ticks   ", F.col("s"), "   # Number of ticks"), freq, text("system.cpu.ipc ", F.col("n") / 4, "% 2.5 nan # per cycle"),
                    F.lit("host.mem inf 1_000"), F.lit("lonely"), F.lit("---------- End Simulation Statistics   ----------"))
    d = rn.parse_run_stats(e.select("run_id", F.posexplode(lines).alias("at", "line")), ordinal="at")
    return d.select("run_id", "stat", F.size("values").alias("n_values"), F.get("values", F.lit(0)).alias("first_value"))


# ---- composed jobs -----------------------------------------------------------------------

_RAW = f"""
, raw AS (SELECT * FROM v_inputs WHERE src_id % 6 <> 2)
, gg AS (SELECT g.src_id, g.problem_id, g.src_runtime, g.gen_idx, g.code, g.accuracy, g.agg_runtime FROM v_generations g JOIN raw USING (src_id) WHERE code IS NOT NULL)
, gi AS (SELECT src_id, problem_id, src_runtime, gen_idx, code, accuracy, agg_runtime FROM gg
   UNION ALL SELECT src_id, problem_id, src_runtime, 0, NULL, 0.0, {INF_SQL} FROM raw i WHERE NOT EXISTS (SELECT 1 FROM gg WHERE gg.src_id = i.src_id))
, g AS (SELECT src_id, problem_id, src_runtime, gen_idx, CASE WHEN code IS NULL OR accuracy IS NULL OR accuracy < 1.0 THEN {INF_SQL} ELSE agg_runtime END AS adj, accuracy FROM gi)
, r AS (SELECT src_id, src_runtime, gen_idx + 1 AS k, min(adj) OVER w AS best_runtime, max(accuracy) OVER w AS best_accuracy FROM g
    WINDOW w AS (PARTITION BY src_id ORDER BY gen_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, ks AS (SELECT DISTINCT k FROM r)
, d AS (SELECT ks.k, r.best_accuracy, {floor1(sdiv('r.src_runtime', 'r.best_runtime'))} AS speedup, coalesce(r.best_accuracy = 1.0, false) AS ok
  FROM ks JOIN r ON r.k <= ks.k QUALIFY row_number() OVER (PARTITION BY ks.k, r.src_id ORDER BY r.k DESC) = 1)
"""


def _raw_pairs(spark, sf):
    """Inputs with the text of their answer lists; every sixth pair is identical."""
    i, k = view(spark, sf, "v_inputs"), F.col("src_id")
    src = F.concat(F.lit(" slow "), k.cast("string"), F.lit("\n"))
    return i.join(_answer_lists(spark, sf).select("src_id", "generated_answers"), "src_id", "left").select(
        "src_id", "problem_id", src.alias("src_code"), F.when(k % 6 == 2, src).otherwise(F.concat(F.lit("fast "), k.cast("string"))).alias("tgt_code"),
        F.col("src_runtime").alias("src_agg_runtime"), F.col("tgt_runtime").alias("tgt_agg_runtime"), "generated_answers")


@query("evaluate_answers_summary", oracle_with(["v_generations", "v_inputs"], _RAW + f"""
SELECT CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n_inputs, {fin('avg(best_accuracy)')} AS mean_accuracy,
  {fin('avg(CAST(ok AS DOUBLE))')} AS share_correct, {fin('avg(speedup)')} AS mean_speedup, {_shares_sql('speedup')} FROM d GROUP BY k"""))
def evaluate_answers_summary(spark, sf):
    """The whole evaluation from raw pairs: lists as text, identical pairs, answers without code."""
    return jobs.evaluate_answers(_raw_pairs(spark, sf), view(spark, sf, "v_generations").select("src_id", "gen_idx", "accuracy", "agg_runtime"))["summary"]


@query("evaluate_answers_wide", oracle_with(["v_generations", "v_inputs"], _RAW + f"""
SELECT raw.src_id, {fin('any_value(raw.src_runtime)')} AS src_code_agg_runtime, {fin('any_value(raw.tgt_runtime)')} AS tgt_code_agg_runtime,
  {', '.join(f"{fin(f'max({c}) FILTER (WHERE gen_idx = {i})')} AS answer_{i}_{c}" for i in range(3) for c in ('accuracy', 'agg_runtime'))}
FROM raw LEFT JOIN gg USING (src_id) GROUP BY raw.src_id"""))
def evaluate_answers_wide(spark, sf):
    """One row per input, with its first three answers as columns."""
    d = jobs.evaluate_answers(_raw_pairs(spark, sf), view(spark, sf, "v_generations").select("src_id", "gen_idx", "accuracy", "agg_runtime"), max_answers=3)["wide"]
    return rs.select_report_columns(d, names=["src_id", "src_code_agg_runtime", "tgt_code_agg_runtime"], parts=["answer_"])


@query("a6_speedup_shares_grouped", oracle_with(["v_inputs"], f"""
, t AS (SELECT unnest([{', '.join(str(t) for t in ev.SPEEDUP_THRESHOLDS)}]::DOUBLE[]) AS threshold)
, x AS (SELECT src_id % 4 AS part, {sdiv('src_runtime', 'tgt_runtime')} AS sp FROM v_inputs)
SELECT CAST(part AS BIGINT) AS part, threshold, {fin('avg(CASE WHEN sp >= threshold THEN 1.0 ELSE 0.0 END)')} AS share FROM x, t GROUP BY part, threshold"""))
def a6_speedup_shares_grouped(spark, sf):
    """Shares above the thresholds by group, over the speedup column itself."""
    from pairlab.functions.numeric import safe_divide
    d = view(spark, sf, "v_inputs").select((F.col("src_id") % 4).alias("part"), safe_divide(F.col("src_runtime"), F.col("tgt_runtime")).alias("sp"))
    return ev.speedup_shares(d, "sp", by=["part"])


_MINE = _PASS + f"""
, subs AS (SELECT r_regionkey AS problem_id, c_custkey AS program_id, c_acctbal AS agg_runtime, c_name AS code FROM customer, region
           WHERE c_custkey % 9 <> 4 AND c_custkey % 31 <> 0)
, top AS (SELECT * FROM subs QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY agg_runtime, program_id) <= 200)
, best AS (SELECT t.problem_id, arg_min(t.program_id, (agg_runtime, t.program_id)) AS program_id FROM top t JOIN pass p USING (problem_id, program_id) WHERE p.passed GROUP BY t.problem_id)
, num AS (SELECT problem_id, count(*) AS n FROM subs GROUP BY problem_id)
, s AS (SELECT best.problem_id, best.program_id, least(n, 200) AS num_submissions, n AS n_accepted, {ntok('c_name')} AS code_length FROM best JOIN num USING (problem_id) JOIN customer ON c_custkey = best.program_id)
"""


@query("mine_seeds_full", oracle_with(["v_outputs", "v_expected"], _MINE + """
SELECT CAST(problem_id AS BIGINT) AS problem_id, program_id, CAST(num_submissions AS BIGINT) AS num_submissions, CAST(n_accepted AS BIGINT) AS n_accepted, code_length,
  CAST(25 AS BIGINT) AS n_tests, true AS has_text FROM s WHERE problem_id <> 3 ORDER BY n_accepted DESC, problem_id LIMIT 3"""))
def mine_seeds_full(spark, sf):
    """Seeds with every step: status, outputs against expected texts, descriptions of pages, lengths, test counts, sample."""
    outs, expected = view(spark, sf, "v_outputs"), view(spark, sf, "v_expected")
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("program_id"), F.col("c_name").alias("code"),
                                               F.when(F.col("c_custkey") % 31 != 0, F.col("c_acctbal")).alias("agg_runtime"),
                                               F.when(F.col("c_custkey") % 9 != 4, "Accepted").otherwise("Wrong").alias("status"))
    subs = outs.select("problem_id", "program_id").distinct().join(cust, "program_id")
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("problem_id"), "html")
    tests = expected.filter("problem_id <> 3 OR tc_no < 10").select("problem_id", "tc_no")
    d = jobs.mine_seeds(subs, outputs=outs, expected=expected, descriptions=jobs.describe_problems(pages), tests=tests, program="program_id", code="code", n=3, top=200)
    return d.select("problem_id", "program_id", "num_submissions", "n_accepted", "code_length", "n_tests", (F.col("text_description_length") > 0).alias("has_text"))


_NOVEL = """
, cp AS (SELECT c_custkey AS program_id, c_custkey % 40 AS request_id, 'write program ' || c_custkey % 40 AS template,
    CASE WHEN c_custkey % 35 = 0 THEN 'Openai timed out' WHEN c_custkey % 55 <> 0 THEN c_comment_ END AS code FROM (SELECT *, c_name || ' does it' AS c_comment_ FROM customer) WHERE c_custkey % 5 = 0)
, ok AS (SELECT program_id FROM cp WHERE code IS NOT NULL AND code <> 'Openai timed out')
"""


def _novel_job(spark, sf):
    k = F.col("program_id")
    comp = table(spark, sf, "customer").filter("c_custkey % 5 = 0").select(
        F.col("c_custkey").alias("program_id"), (F.col("c_custkey") % 40).alias("request_id"), F.concat(F.lit("write program "), (F.col("c_custkey") % 40).cast("string")).alias("template"),
        F.concat("c_name", F.lit(" does it")).alias("code"))
    comp = comp.withColumn("code", F.when(k % 35 == 0, F.lit(au.FAILED_COMPLETION)).when(k % 55 != 0, F.col("code")))
    return jobs.select_novel(view(spark, sf, "v_outputs"), completions=comp)


def _novel_sql(body: str) -> str:
    from pairlab.plans.q_augment import _TOP20
    return oracle_with(["v_outputs"], _TOP20 + _NOVEL + f"""
, novel AS (SELECT cands.problem_id, cands.program_id FROM cands JOIN ok USING (program_id) LEFT JOIN nm ON nm.problem_id = cands.problem_id AND nm.cand = cands.program_id
            WHERE runs_all AND coalesce(nm.n_matching, 0) = 0)
, nov_out AS (SELECT o.* FROM v_outputs o JOIN novel USING (problem_id, program_id) WHERE kind = 'candidate')
, sig AS (SELECT program_id, string_agg(problem_id || ':' || tc_no || ':' || output, '|' ORDER BY problem_id, tc_no) AS s FROM nov_out GROUP BY program_id)
, grp AS (SELECT s, count(*) AS m FROM sig GROUP BY s)
, req AS (SELECT request_id, count(*) FILTER (WHERE code IS NOT NULL AND code <> 'Openai timed out') AS n_ok FROM cp GROUP BY request_id)
, x AS (SELECT program_id, coalesce(code IS NULL OR code = 'Openai timed out', true) AS failed, {ntok('template')} AS template_len, n_ok,
    CASE WHEN code IS NULL OR code = 'Openai timed out' THEN 0 ELSE {ntok('code')} END AS generation_len FROM cp JOIN req USING (request_id))
, y AS (SELECT program_id, failed, template_len, generation_len, CASE WHEN failed THEN 0.0 ELSE CAST(generation_len AS DOUBLE) * CAST({au.COMPLETION_RATE_PER_1K} AS DOUBLE) / 1000.0
    + (CAST(template_len AS DOUBLE) * CAST({au.PROMPT_RATE_PER_1K} AS DOUBLE) / 1000.0) / n_ok END AS total_cost FROM x)
""" + body)


@query("select_novel_costs", _novel_sql(f"""
SELECT y.program_id, failed, {fin('total_cost')} AS total_cost, y.program_id IN (SELECT program_id FROM novel) AS is_different FROM y"""))
def select_novel_costs(spark, sf):
    """Every completion's cost and whether it is novel somewhere; failed ones cost nothing and never are."""
    return _novel_job(spark, sf)["costs"].select("program_id", "failed", "total_cost", "is_different")


@query("select_novel_cost_summary", _novel_sql(f"""
, u AS (SELECT count(*) AS unique_programs, coalesce(sum(m), 0) AS total_programs FROM grp)
SELECT {fin('sum(total_cost)')} AS total_cost, {fin('avg(template_len)')} AS avg_template_len, {fin('avg(generation_len)')} AS avg_generation_len,
  CAST(any_value(unique_programs) AS BIGINT) AS unique_programs, {fin('CASE WHEN any_value(unique_programs) > 0 THEN sum(total_cost) / any_value(unique_programs) ELSE ' + INF_SQL + ' END')} AS cost_per_unique FROM y, u"""))
def select_novel_cost_summary(spark, sf):
    d = _novel_job(spark, sf)["cost_summary"]
    return d.select("total_cost", "avg_template_len", "avg_generation_len", "unique_programs", "cost_per_unique")


_PCT = pp.TEMPLATES["code_opt_w_speedup_pctile"][0]


@query("write_training_files_job", oracle_with(["v_pairs"], _PAIRS_TAGGED.replace("FROM v_pairs)", "FROM v_pairs WHERE src_id % 3 <> 2)") + f"""
, pv AS (SELECT *, CAST(length(tgt_code) AS DOUBLE) AS rt FROM v_pairs WHERE src_id % 3 = 2)
, pw AS (SELECT problem_id, min(rt) AS best FROM pv GROUP BY problem_id)
, tv AS (SELECT pv.*, CAST(CAST(greatest(1, ceil(CAST(10.0 AS DOUBLE) * (best / rt))) AS BIGINT) AS VARCHAR) AS pctile FROM pv JOIN pw USING (problem_id))
, al AS (SELECT 'train' AS split, src_id, src_code, tgt_code, pctile FROM tagged UNION ALL SELECT 'validation', src_id, src_code, tgt_code, pctile FROM tv)
SELECT split, src_id, pctile, sha256({_prompt_sql(_PCT, {'pctile': 'pctile'})} || substr(tgt_code, 1, 1500)) AS prompt_hash FROM al"""))
def write_training_files_job(spark, sf):
    """Tagged, shuffled prompts of two splits written as JSON lines in a versioned folder, and read back."""
    p = view(spark, sf, "v_pairs").withColumn("rt", F.length("tgt_code").cast("double"))
    root = f"{checkpoint_dir(spark)}/training/{uuid.uuid4().hex}"
    splits = {"train": p.filter("src_id % 3 <> 2"), "validation": p.filter("src_id % 3 = 2")}
    paths = jobs.write_training_files(splits, root, "one", template="code_opt_w_speedup_pctile", seed=3, runtime="rt")
    schema = T.StructType([T.StructField("src_id", T.LongType()), T.StructField("pctile", T.StringType()), T.StructField("prompt", T.StringType())])
    d = io.read_splits(spark, paths, schema)
    return d.select("split", "src_id", "pctile", F.sha2("prompt", 256).alias("prompt_hash"))
