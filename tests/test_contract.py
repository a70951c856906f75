"""Every query against its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as contract
from tests.check import connection, differences
from treeloom.plans import queries as plans

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def db():
    return connection(SF_DIR)


def test_entry(spark):
    assert contract.entry(spark).count() == 4


def test_every_query_has_its_sql():
    """All but those of the pipeline subpackage, whose own tests compare them with brute force."""
    assert set(plans.queries()) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, db, name):
    assert differences(spark, db, SF_DIR, name) is None
