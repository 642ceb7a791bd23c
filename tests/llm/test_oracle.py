"""Queries that SQL can express against that SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from footfall.llm.oracle import ORACLE
from footfall.llm.queries import QUERIES


@pytest.fixture(scope="module")
def other_engine(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, small, other_engine):
    frame, expected = QUERIES[name](spark, small), other_engine.sql(ORACLE[name])
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    texts = lambda rows, names: sorted(str([row[names.index(c)] for c in columns]) for row in rows)
    assert texts(frame.collect(), frame.columns) == texts(expected.fetchall(), expected.columns)
