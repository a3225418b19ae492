"""Every query against its SQL on the smallest tables, and plans without accidental products."""

import glob
import math
import os

import duckdb
import pytest

from tessera import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return str(int(v)) if math.isfinite(v) and v == int(v) else repr(v)
    return v.isoformat().removesuffix("T00:00:00") if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = duck.sql(registry.ORACLES[name])
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    rows = sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == rows


@pytest.mark.parametrize("name", ["join_interval_overlap", "join_point_in_interval", "join_band_space", "join_fuzzy", "join_attr_vote", "join_cascade", "scan_merge_range", "feat_counts"])
def test_no_products(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_best_rows_by_one_score_of_large_keys(spark, duck, tmp_path):
    """An order number of some millions outweighs a quantity."""
    rows = [(9_000_000, 1, 1, 9.0, "N"), (1_000_000, 1, 1, 5.0, "N"), (2, 1, 3, 1.0, "R"), (9_000_000, 2, 1, 9.0, "A"), (4, 2, 2, 5.0, "A"), (7, 3, 1, None, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    sql = registry.ORACLES["agg_argmax_rule"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, registry.QUERIES["agg_argmax_rule"](spark, str(tmp_path)).collect())) == sorted(duck.sql(sql).fetchall())
