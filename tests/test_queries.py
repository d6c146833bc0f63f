"""Every registered query against its SQL, and the shape of its plan."""

import pytest

from prefmine.queries import load
from tests.oracle import compare, connect

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


# For the queries without SQL a solver or a text library decides the values: rows and finite numbers are all
# that is asked for here, other tests look at the parts.


def finite(value):
    if isinstance(value, (list, tuple)):
        return all(finite(v) for v in value)
    return not isinstance(value, float) or abs(value) < float("inf")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_unchecked(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows and all(finite(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, sf_dir, con, name):
    plans = []

    def run(session, folder):
        df = QUERIES[name](session, folder)
        plans.append(df)
        return df

    ok, note = compare(spark, sf_dir, run, ORACLES.get(name), con)
    assert ok, note
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    rows = {r["subset"]: r for r in entry.entry(spark).collect()}
    assert rows["all"]["n"] == rows["warm"]["n"] == 1132
    assert (rows["all"]["rmse"], rows["all"]["mae"]) == (1.405662, 1.203111)
    assert set(entry.oracle_sql()) <= set(entry.queries())
