"""Every query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from oracle_check import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, name):
    ok, detail = same(spark, FOLDER, name)
    assert ok, detail


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and rows[0].vec_id == 0
