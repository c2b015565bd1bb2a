"""Every registered query against its SQL on the smallest data."""

import pytest

from spanforge.plans import catalog, oracle
from tests.compare import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names_match():
    assert set(oracle.S) <= set(catalog.REGISTRY)


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_query(spark, con, name):
    cols, rows = spark_rows(catalog.REGISTRY[name](spark, SF))
    if name not in oracle.S:
        assert rows
        return
    want_cols, want = duck_rows(con, oracle.S[name])
    assert cols == want_cols
    assert rows == want
