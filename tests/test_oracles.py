"""Every query of the contact operators against its SQL, over whole tables of the smallest data set."""

import pytest

import __spark_entry__ as driver
from contactlake.plans.oracles import ORACLES
from contactlake.plans.queries import QUERIES
from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert driver.entry(spark).count() == 50 + 150


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert compare(name, spark, connection, SF) == ""
