"""Every registered query equals its SQL on DuckDB, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from scholarflow.plans.oracles import ORACLES
from scholarflow.plans.queries import QUERIES
from tools import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return check.database(SF)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "n_chunks", "markdown"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = check.compare(spark, con, name, SF)
    assert ok, note
