"""Every registered query against its reference SQL, and every other one for rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, difference

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


def test_entry_ranks_blocks(spark):
    rows = entry(spark).collect()
    assert [r.priority for r in rows] == sorted(r.priority for r in rows) and rows


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, data, name):
    got = queries()[name](spark, data).toPandas()
    if name in ORACLES:
        assert difference(got, duck.execute(ORACLES[name]).df()) is None
    else:
        assert len(got)
