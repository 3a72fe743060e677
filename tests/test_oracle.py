"""Every registered query against its DuckDB SQL on the small tables (the driver's check runs
the same comparison on sf0.01; ``python tests/oracle.py`` runs it by hand)."""

import pytest

import __spark_entry__ as E
from textprep.plans import catalog
from oracle import compare, duck

from conftest import SF_SMALL

# the library's own queries; those of the corpus operators have their tests in tests/llm
E.queries()
QUERIES = {name: fn for name, fn in E.queries().items() if name in catalog.QUERIES}
ORACLE = {name: sql for name, sql in E.oracle_sql().items() if name in QUERIES}


# What SQL cannot express, and the test that holds it against something else.
ELSEWHERE = {
    "t20_subword_vocab": "test_subwords.py: the piece model's own library",
    "t1_subword_encode": "test_subwords.py: the piece model's own library",
    "t2_subword_sentences": "test_subwords.py: the piece model's own library",
    "m11_all_folds": "test_fold_models.py: a plain Newton solver, fold by fold",
}


def test_every_query_has_oracle_or_is_model_based():
    assert set(QUERIES) - set(ELSEWHERE) == set(ORACLE)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "cv", "n_docs", "n_chunks", "n_words"]
    assert df.count() >= 1


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, name, QUERIES[name], ORACLE[name], SF_SMALL, con)
    assert ok, msg
