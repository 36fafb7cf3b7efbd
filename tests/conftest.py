from __future__ import annotations

import itertools
import os

import pytest

from tradewell.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    os.environ["SPARK_LOCAL_DIRS"] = str(folder / "local")
    session = local_session(
        8, "tradewell-tests", spark__sql__warehouse__dir=str(folder / "warehouse"),
        spark__checkpoint__dir=str(folder / "checkpoint"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["small", "large"])
def sized(request, spark):
    """Runs a test on the plans for small and for large sides."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "large":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


_number = itertools.count()


@pytest.fixture
def warehouse(spark, tmp_path):
    from tradewell.plans.store import Warehouse

    return Warehouse(spark, f"wh{next(_number)}", str(tmp_path / "informes"))


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, str(v)) for v in r])
