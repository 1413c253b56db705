"""Every registered query that has a SQL twin returns the same rows in DuckDB."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as contract
from sidforge.plans import catalog, oracle

QUERIES = catalog.QUERIES
ORACLE = oracle.oracle_sql()
NO_TWIN = {
    "fit_projection", "fit_codebook", "fit_residual_quantizer", "resolve_collisions",
}


def test_only_iterative_queries_lack_a_twin():
    assert set(QUERIES) - set(ORACLE) == NO_TWIN
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, sf_dir, name):
    problem, _ = compare(spark, con, sf_dir, QUERIES[name], ORACLE[name])
    assert problem == ""


def test_entry_is_the_final_table(spark):
    df = contract.entry(spark)
    assert df.columns[-2:] == ["geo_sid", "mem_sid"]
    assert df.count() == 163
