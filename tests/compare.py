"""Run a registered query on Spark and its SQL twin on DuckDB and compare them as multisets."""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(str, map(_norm, v))) + "]"
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted("|".join(_norm(r[i]) for i in order) for r in rows)


SPARK_S = 0.0
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "float": "FLOAT", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]"}


def compare(spark, con, name, fn, sql, sf):
    """None when equal, else a description of the first difference."""
    t0 = time.time()
    df = fn(spark, sf)
    pdf = df.toArrow()
    s_cols, s_rows = rows_of(df.columns, list(zip(*[c.to_pylist() for c in pdf.columns])) if pdf.num_rows else [])
    n = len(s_rows)
    global SPARK_S
    SPARK_S = time.time() - t0
    if sql is None:
        return n, None if n else "no rows"
    rel = con.execute(sql)
    d_names = [x[0] for x in rel.description]
    d_types = {x[0]: str(x[1]) for x in rel.description}
    d_cols, d_rows = rows_of(d_names, rel.fetchall())
    if s_cols != d_cols:
        return n, f"columns {s_cols} vs {d_cols}"
    bad = [f"{c}: {t} vs {d_types[c]}" for c, t in df.dtypes if TYPES.get(t, t.upper()) != d_types[c]]
    if len(s_rows) != len(d_rows):
        return n, f"rows {len(s_rows)} vs {len(d_rows)}"
    if s_rows != d_rows:
        from collections import Counter

        a, b = Counter(s_rows), Counter(d_rows)
        only_s, only_d = sorted((a - b).elements()), sorted((b - a).elements())
        return n, f"{len(only_s)} of {n} differ; cols {s_cols}; spark {only_s[:2]} duck {only_d[:2]}"
    if bad:
        return n, f"types {bad}"
    return n, None


def main(argv):
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from pixelweave.session import local_session

    sf = "/root/testdata/" + argv[0]
    pats = argv[1:]
    spark = local_session()
    con = duck(sf)
    qs, orc = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in pats):
            continue
        t0 = time.time()
        try:
            n, why = compare(spark, con, name, fn, orc.get(name), sf)
        except Exception as e:  # report and go on
            n, why = 0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += why is not None
        print(f"{'FAIL' if why else 'ok  '} {name:32s} {n:8d} rows {time.time() - t0:6.2f}s (spark {SPARK_S:5.1f}s) "
              f"{'' if name in orc else '(rows only)'} {why or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
