"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, connect

from duoscope.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    fn, sql = REGISTRY[name]
    df = fn(spark, SF)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) is None
