"""Run registered queries and their SQL side by side.

``python tests/compare.py [sf_dir] [name…]`` prints one line per query.
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else ("-0.0" if v == 0 and math.copysign(1, v) < 0 else v)
    return v


def _sortable(row):
    return tuple((v is not None, "n" if isinstance(v, (int, float)) else str(type(v)), v) for v in row)


def _rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=_sortable)


_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(spark, con, sf_dir: str, name: str) -> str:
    """'' when equal, else the first difference."""
    df = queries()[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    rel = con.sql(oracle_sql()[name])
    names, kinds = list(rel.columns), [str(t) for t in rel.types]
    want = _rows(names, rel.fetchall())
    schema = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    expected = sorted((n, _KINDS.get(k, k)) for n, k in zip(names, kinds))
    if schema != expected:
        return f"schema {schema} != {expected}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} != {w}"
    return "" if got else "no rows"


if __name__ == "__main__":
    from barcast.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or [n for n in queries() if n in oracle_sql()]
    spark, con = local_session(8), connect(sf)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            problem = compare(spark, con, sf, name)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {name:22s} {time.time() - start:6.2f}s {problem}", flush=True)
    missing = sorted(set(oracle_sql()) - set(queries()))
    print("failed", failed, "of", len(chosen), "orphans", missing)
