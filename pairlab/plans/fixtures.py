"""Input tables derived from the driver's parquet tables.

Each view is one SQL text run unchanged by Spark (``spark.sql`` with DataFrame
parameters) and by the DuckDB oracle (as a leading ``WITH``).  Placeholders
``{table}`` name base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

_ORDER_LI = ("l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, "
             "l_discount, l_tax, l_shipdate")

VIEWS: dict[str, str] = {
    # EVAL long form: several answers per input (one order = one input).
    "v_generations": f"""
SELECT l_orderkey AS src_id, o_custkey AS problem_id, o_totalprice AS src_runtime,
  o_totalprice * (1 - CAST(o_orderkey % 10 AS DOUBLE) / 12.0) AS tgt_runtime,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_LI}) - 1 AS INT) AS gen_idx,
  CASE WHEN l_tax >= 0.08 THEN NULL ELSE concat('p', CAST(l_partkey AS STRING)) END AS code,
  CASE WHEN l_tax >= 0.08 THEN NULL WHEN l_discount <= 0.06 THEN CAST(1.0 AS DOUBLE) ELSE 1 - l_discount END AS accuracy,
  CASE WHEN l_tax >= 0.08 THEN NULL ELSE l_extendedprice END AS agg_runtime
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    # every evaluation input, including those with no answers at all
    "v_inputs": """
SELECT o_orderkey AS src_id, o_custkey AS problem_id, o_totalprice AS src_runtime,
  o_totalprice * (1 - CAST(o_orderkey % 10 AS DOUBLE) / 12.0) AS tgt_runtime
FROM {orders}""",
    "v_submissions": f"""
SELECT src_id * 100 + gen_idx AS submission_id, l.*
FROM (SELECT l_orderkey AS src_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_LI}) - 1 AS INT) AS gen_idx, l_partkey AS problem_id,
  CASE WHEN l_returnflag = 'R' AND l_quantity < 5 THEN NULL ELSE l_extendedprice END AS agg_runtime,
  CASE WHEN l_linestatus = 'F' THEN 'Accepted' ELSE 'Rejected' END AS status
FROM {{lineitem}}) l""",
    # Output map: every program run on every test of every problem.  nation (25
    # tests) and region (5 problems) are fixed-size dimensions.
    "v_outputs": """
SELECT r_regionkey AS problem_id, n_nationkey AS tc_no, c_custkey AS program_id,
  CASE WHEN c_custkey % 5 = 0 THEN 'candidate' ELSE 'reference' END AS kind,
  CASE WHEN c_custkey % 97 = 0 AND n_nationkey = 7 THEN 'error' WHEN c_custkey % 15 = 0 AND n_nationkey = 20 THEN concat('x', CAST(c_custkey % 30 AS STRING)) ELSE CAST((c_nationkey * (n_nationkey + 1) + r_regionkey) % 7 AS STRING) END AS output
FROM {customer} CROSS JOIN {nation} CROSS JOIN {region}""",
    "v_expected": """
SELECT r_regionkey AS problem_id, n_nationkey AS tc_no, CAST((3 * (n_nationkey + 1) + r_regionkey) % 7 AS STRING) AS expected
FROM {nation} CROSS JOIN {region}""",
    "v_repeats": """
SELECT user_id AS submission_id, event_type AS tc,
  CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INT) AS rep, value AS t
FROM {events}""",
    "v_test_runs": """
SELECT user_id AS submission_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, event_type <> 'error' AS success, value AS t
FROM {events}""",
    "v_pairs": """
SELECT u.conv_id * 100 + u.turn AS src_id, u.conv_id % 20 AS problem_id, u.text AS src_code, a.text AS tgt_code, CAST(length(u.text) AS DOUBLE) / length(a.text) AS speedup
FROM {conversations} u JOIN {conversations} a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


#: tables of which a view makes many rows from each, and how many of their rows a task takes
SPREAD = {"v_outputs": {"customer": 1 << 13}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _read(spark: SparkSession, sf_dir: str, name: str, rows: int | None) -> DataFrame:
    """A table, in as many partitions as its rows ask for: a small file is one task, whatever its rows become."""
    d = table(spark, sf_dir, name)
    n = -(-d.count() // rows) if rows else 1
    return d.repartition(n) if n > 1 else d


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, spread = VIEWS[name], SPREAD.get(name, {})
    names = sorted(set(_PLACEHOLDER.findall(sql)))
    return spark.sql(sql, **{n: _read(spark, sf_dir, n, spread.get(n)) for n in names})


def oracle_with(views: list[str], body: str) -> str:
    """DuckDB text: the named views as a leading WITH, then ``body``."""
    ctes = []
    for v in views:
        text = _PLACEHOLDER.sub(lambda m: m.group(1), VIEWS[v]).strip()
        ctes.append(f"{v} AS ({text})")
    body = body.strip()
    if body.startswith(","):  # body brings CTEs of its own
        return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else "WITH " + body[1:]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
