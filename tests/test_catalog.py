"""Every registered query against its SQL equivalent."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, ORACLE = contract.queries(), {k: v for k, v in contract.oracle_sql().items() if k not in contract.LLM_ORACLE}


def _views(folder):
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def other_engine(tables):
    return _views(tables)


def _texts(rows, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(tuple(str(row[i]) for i in at) for row in rows)


def _compare(name, spark, folder, engine):
    frame = QUERIES[name](spark, folder)
    expected = engine.sql(ORACLE[name])
    names = sorted(frame.columns)
    assert names == sorted(expected.columns)
    assert _texts(frame.collect(), frame.columns, names) == _texts(expected.fetchall(), expected.columns, names)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, tables, other_engine):
    _compare(name, spark, tables, other_engine)


@pytest.mark.parametrize("name", ["bbox_filter_stored", "convex_hull_vertices", "dbscan", "eps_threshold", "eps_threshold_coarse", "extract_rois_vertices", "roi_quality_extracted"])
def test_rings_and_clusters_match_sql_at_the_next_scale(name, spark):
    folder = "/root/testdata/sf0.01"
    _compare(name, spark, folder, _views(folder))


def test_part_names_beyond_the_first_reach_the_tags(spark):
    frame = QUERIES["explode_tags"](spark, "/root/testdata/sf0.01")
    parts = spark.read.parquet("/root/testdata/sf0.01/part.parquet").filter("p_partkey >= 200")
    words = {w for r in parts.select("p_name").distinct().collect() for w in r.p_name.split(" ")}
    assert words & {r.tag for r in frame.select("tag").distinct().collect()}


def test_no_statement_without_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 21
