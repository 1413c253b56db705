"""Queries of this part beside their SQL twins."""

import pytest
from oracle_check import compare, connect

from sidforge.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, sf_dir, name):
    problem, _ = compare(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLE[name])
    assert problem == ""
