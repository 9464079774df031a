"""Every registered query of the reference's kind against its SQL."""

import duckdb
import pytest

from foliate.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(values):
    return sorted((tuple(r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(tuple(r[c] for c in columns) for r in df.collect())
    relation = con.execute(registry.ORACLES[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == rows(tuple(r[i] for i in at) for r in relation.fetchall())


def test_native_plans(spark):
    """No Python on the executors."""
    for name, f in registry.QUERIES.items():
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
