"""Every registered query against its SQL, on the plans for small and for large tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
from driver_queries.frames import QUERIES
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(NAMES) <= set(registered.oracle_sql()) and set(NAMES) <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).columns == ["anio", "lineas", "roles"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, oracle, name):
    assert difference(oracle, registered.queries()[name](spark, FOLDER), registered.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", NAMES)
def test_query_without_broadcasts(spark, oracle, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = registered.queries()[name](spark, FOLDER)
        assert difference(oracle, frame, registered.oracle_sql()[name]) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
