"""The corpus queries against their DuckDB SQL on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline
from oracle import compare, duck

import __spark_entry__ as E
from textprep.llm import queries

SF = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(queries.ORACLE) <= set(E.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, con, name):
    ok, msg = compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF, con)
    assert ok, msg
