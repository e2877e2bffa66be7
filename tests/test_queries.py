"""Every query of the reference's operators against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from codelens import code_queries, run_queries, table_queries

SMALL = "/root/testdata/sf0.001"
QUERIES = code_queries.QUERIES | table_queries.QUERIES | run_queries.QUERIES
SQL = code_queries.SQL | table_queries.SQL | run_queries.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(found, columns):
    clean = lambda v: round(v, 9) if isinstance(v, float) else list(v) if isinstance(v, tuple) else v
    return sorted((tuple(clean(r[k]) for k in columns) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    assert sorted(got.columns) == sorted(names)
    assert rows([r.asDict() for r in got.collect()], sorted(names)) == rows(want, sorted(names))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_hunks_and_functions_of_all_orders(spark, tmp_path):
    items = [(order, 1 + (order * 3 + n) % 40, n) for order in range(1, 61) for n in range(1, 4)]
    suppliers = [(k, f"f{k}") for k in range(1, 46)]
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    hunks = {(o, f"src/m{o % 7}.c", s, s + n - 1, s + 1, s + 1) for o, s, n in items}
    touched = {(o, f"/p/src/m{o % 7}.c", name) for o, s, _ in items for k, name in suppliers if k % 7 == o % 7 and k <= s + 1 <= k + 5}
    assert {o for o, *_ in touched} - {o for o in range(0, 61, 10)}
    for name, want in (("diff_hunks", hunks), ("touched_functions", touched)):
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert len(got) == len(want) and set(got) == want, name
