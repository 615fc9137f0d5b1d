"""Every registered query against its DuckDB twin on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

from quirelane.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")


def norm(v):
    if v is None or isinstance(v, (bool, str, bytes, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, DATA)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_merged_cells_of_all_orders(spark):
    got = registry.QUERIES["merged_cells"](spark, DATA).select("doc_id").distinct().collect()
    want = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").distinct().collect()
    assert {r[0] for r in got} == {r[0] for r in want}
