"""Every registered query of the audit against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from needledrop.oracles import ORACLES
from needledrop.queries import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "part", "orders"):
        c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    if name not in ORACLES:
        assert rows
        return
    cursor = duck.execute(f"select {', '.join(columns)} from ({ORACLES[name]})")
    assert rows == sorted(map(repr, cursor.fetchall()))
