"""Compare a registered query with its DuckDB oracle (order-insensitive).

    python -m pairlab.plans.check [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

from pairlab.plans.fixtures import TABLES


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return None
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _canon(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _canon(v.asDict())
    return str(v)


_SPARK_FAMILY = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float",
                 "float": "float", "string": "str", "boolean": "bool"}
_DUCK_FAMILY = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "int", "SMALLINT": "int", "DOUBLE": "float",
                "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool"}


def _families(df, res):
    sp = {f.name: _SPARK_FAMILY.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    dk = {d[0]: _DUCK_FAMILY.get(str(d[1]), str(d[1])) for d in res.description}
    return sp, dk


def compare(spark, con, name: str, sf_dir: str) -> dict:
    from pairlab.plans.queries import REGISTRY
    q = REGISTRY[name]
    t0 = time.time()
    df = q.build(spark, sf_dir)
    rows = df.collect()
    t_spark = time.time() - t0
    cols = df.columns
    out = {"name": name, "rows": len(rows), "spark_sec": round(t_spark, 2)}
    if not q.oracle:
        out["status"] = "rows-only"
        return out
    res = con.execute(q.oracle)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    out["oracle_rows"] = len(orows)
    if sorted(cols) != sorted(ocols):
        out["status"] = f"schema mismatch spark={sorted(cols)} oracle={sorted(ocols)}"
        return out
    sp, dk = _families(df, res)
    bad_types = {c: (sp[c], dk[c]) for c in cols if sp[c] != dk[c]}
    if bad_types:
        out["status"] = f"type mismatch {bad_types}"
        return out
    order = sorted(cols)
    si = [cols.index(c) for c in order]
    oi = [ocols.index(c) for c in order]
    a = sorted((tuple(_canon(r[i]) for i in si) for r in rows), key=repr)
    b = sorted((tuple(_canon(r[i]) for i in oi) for r in orows), key=repr)
    if a == b:
        out["status"] = "match"
    else:
        diff = [x for x in a if x not in set(b)][:3]
        diff2 = [x for x in b if x not in set(a)][:3]
        out["status"] = "value mismatch"
        out["spark_only"] = diff
        out["oracle_only"] = diff2
    return out


def main(argv):
    from pairlab.plans.queries import REGISTRY
    from pairlab.session import get_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(REGISTRY)
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "status": f"error {type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("match", "rows-only")
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
