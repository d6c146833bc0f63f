"""Queries whose whole result SQL expresses, against that SQL."""

import pytest

from prefmine.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, sf_dir, name):
    ok, note = compare(spark, sf_dir, QUERIES[name], ORACLES[name], connect(sf_dir))
    assert ok, note
