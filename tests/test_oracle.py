"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from fleetvitals.plans import bindings, report_bindings
from tests.parity import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


LIBRARY = {**bindings.QUERIES, **report_bindings.QUERIES}


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    assert differences(df, duck, contract.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(LIBRARY) <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert df.columns == [
        "l_suppkey", "value", "line_count", "row_rank", "preceding", "share",
    ]
