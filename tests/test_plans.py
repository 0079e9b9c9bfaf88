"""Every registered query against its SQL at the smallest scale."""

import pytest

from featherlens import plans

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, con, name):
    assert compare(spark, con, plans.QUERIES[name], plans.SQL[name], SF) == ""
