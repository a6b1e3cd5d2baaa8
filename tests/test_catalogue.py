"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from pyspark.sql import functions as F

from graphloom.operators import statistics
from graphloom.plans import catalogue, stand_ins

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


def rows(frame, columns):
    def plain(x):
        if x is None or x != x:
            return "null"
        return str(int(x)) if isinstance(x, float) and math.isfinite(x) and x == int(x) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_duckdb(name, spark, duck):
    ours, theirs = catalogue.QUERIES[name](spark, SF_DIR).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_adjacency_gathers_no_lists(spark):
    assert "collect_list" not in catalogue.QUERIES["a7_adjacency"](spark, SF_DIR)._jdf.queryExecution().toString()


def test_every_outcome_occurs(spark):
    """The derived tables are whole, and queries meet every case they tell apart."""
    t = stand_ins.Tables(spark, SF_DIR)
    assert t.symbols.count() == t.nodes.count() + t.read("supplier").count()
    assert t.references.count() > t.calls.count() + t.nodes.count()
    run = lambda name: catalogue.QUERIES[name](spark, SF_DIR)
    assert {r["reason"] for r in run("j5_resolve").select("reason").distinct().collect()} == {"SameFile", "Unique", "Ambiguous", "NotFound"}
    assert {r["reason"] for r in run("j16_unresolved").select("reason").distinct().collect()} == {"Ambiguous", "NotFound"}
    assert 0 < run("u5_set_difference").count() < t.nodes.count()
    assert 0 < run("g4_impact").where("tests > 0").count() < run("g4_impact").count()
    assert run("a4_schema_version").where("version = 0").count() > 0 < run("a4_schema_version").where("version > 0").count()
    assert {r["symbol_kind"] for r in run("f8_kind_numbers").collect()} == {1, 5, 99}
    found = run("s1_tree_paths").select("path", "language").collect()
    assert {r["language"] for r in found} == {"rust", "typescript"} and {r["path"].split("/")[0] for r in found} == {"src", "lib", "dist.d"}
    for name, sql in catalogue.ORACLE_SQL.items():
        assert "% 11" not in sql and "% 29" not in sql, name


def test_ranked_over_many_ranges(spark):
    rows = spark.range(1000).select((999 - F.col("id")).alias("id"), (F.col("id") % 7).alias("n"))
    got = {r["id"]: r["rank"] for r in statistics.ranked(rows, F.desc("n"), "id").collect()}
    order = sorted(got, key=lambda i: (-((999 - i) % 7), i))
    assert got == {i: k + 1 for k, i in enumerate(order)} and len(got) == 1000
    assert statistics.ranked(rows.limit(0), "id").count() == 0
