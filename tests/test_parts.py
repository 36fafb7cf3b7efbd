"""Tables in parts: merges that rewrite only what changed, versions that readers see whole."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructType

from tests.conftest import rows
from tradewell.plans.parts import ConcurrentChange, PartTable, key_bucket

SCHEMA = StructType().add("k", IntegerType()).add("e", StringType()).add("a", StringType()).add("b", DoubleType())


@pytest.fixture
def table(spark, tmp_path):
    table = PartTable(spark, str(tmp_path / "t"), SCHEMA, keys=["k", "e"], buckets=16)
    table.merge(spark.createDataFrame([(i, "X", f"a{i}", float(i)) for i in range(200)], "k long, e string, a string, b float"))
    return table


def runs(manifest):
    return {part: tuple(r) for part, r in manifest.parts.items()}


def test_one_key_rewrites_one_bucket(spark, sized, table):
    before = table.manifest()
    reader = table.read()
    after = table.merge(spark.createDataFrame([(7, "X", "new")], "k int, e string, a string"))
    bucket = spark.createDataFrame([(7, "X")], "k int, e string").select(key_bucket(["k", "e"], 16)).first()[0]
    assert [p for p in after.parts if runs(after)[p] != runs(before).get(p)] == [f"cubeta={bucket}"]
    # A reader that began before sees its version, the next one sees the new one; column b stays.
    assert rows(reader.filter("k = 7")) == [(7, "X", "a7", 7.0)] and rows(table.read().filter("k = 7")) == [(7, "X", "new", 7.0)]
    assert table.read().count() == 200 and table.read().schema == SCHEMA


def test_equal_rows_and_known_keys_change_nothing(spark, table):
    before = table.manifest()
    same = spark.createDataFrame([(i, "X", f"a{i}", float(i)) for i in range(0, 200, 3)], SCHEMA)
    assert table.merge(same) == before
    other = spark.createDataFrame([(3, "X", "other", None)], SCHEMA)
    assert table.merge(other, ignore=True) == before and table.merge(other, update=[]) == before
    assert table.merge(other, update=["b"]).number == before.number + 1
    assert rows(table.read().filter("k = 3")) == [(3, "X", "a3", None)]


def test_new_keys_and_nulls(spark, sized, table):
    table.merge(spark.createDataFrame([(500, "Y", None, None), (7, "Y", "é", 1.0), (8, "X", None, None)], SCHEMA))
    assert rows(table.read().filter("e = 'Y' or k = 8")) == [(500, "Y", None, None), (7, "Y", "é", 1.0), (8, "X", None, None)]
    assert table.read().count() == 202
    table.merge(spark.createDataFrame([(8, "X", "mine", 1.0), (9, "Z", "mine", 1.0)], SCHEMA), ignore=True)
    assert rows(table.read().filter("a = 'mine'")) == [(9, "Z", "mine", 1.0)]


def test_no_parts_have_the_columns_of_some(spark, table):
    """A merge that rewrites all buckets leaves none, which are still put beside the others."""
    now = table.manifest()
    some, none = table._stored(now, list(now.parts)), table._stored(now, [])
    assert some.schema == none.schema and some.unionByName(none).count() == 200


def test_two_writers_of_one_version(spark, table):
    base = table.manifest()
    table.merge(spark.createDataFrame([(1, "X", "first", 1.0)], SCHEMA), base=base)
    with pytest.raises(ConcurrentChange):
        table.merge(spark.createDataFrame([(2, "X", "second", 1.0)], SCHEMA), base=base)
    assert rows(table.read().filter("k in (1, 2)").select("a")) == [("a2",), ("first",)]


def test_failed_run_leaves_the_old_version(spark, table, monkeypatch):
    old = rows(table.read())

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(table, "_commit", stop)
        with pytest.raises(RuntimeError):
            table.merge(spark.createDataFrame([(1, "X", "lost", 1.0)], SCHEMA))
    assert rows(table.read()) == old
    table.merge(spark.createDataFrame([(1, "X", "kept", 1.0)], SCHEMA))
    assert rows(table.read().filter("k = 1").select("a")) == [("kept",)]
    assert table.vacuum(keep=1) >= 1 and table.read().count() == 200
    assert table.vacuum(keep=1) == 0 and len(table.numbers()) == 1


def test_days(spark, tmp_path):
    days = PartTable(spark, str(tmp_path / "d"), StructType().add("k", IntegerType()).add("d", DateType()), column="d")
    assert days.read().count() == 0

    def frame(*pairs):
        return spark.createDataFrame([(k, date(2025, 3, x) if x else None) for k, x in pairs], "k int, d date")

    days.replace(frame((1, 1), (2, 1), (3, 2), (4, 3), (9, None)))
    reader = days.read()
    days.replace(frame((5, 2)), gone=[days.part_of(date(2025, 3, x)) for x in (2, 3)])
    days.append(frame((6, 1), (7, 4)))
    assert rows(days.read().select("k")) == [(1,), (2,), (5,), (6,), (7,), (9,)]
    assert rows(reader.select("k")) == [(1,), (2,), (3,), (4,), (9,)]
    plan = days.read().filter("d = DATE'2025-03-01'")
    assert len(plan.inputFiles()) >= 1 and rows(plan.select("k")) == [(1,), (2,), (6,)]
    days.replace_all(frame())
    assert days.read().count() == 0


# --- checks of changed parts ---------------------------------------------------------------

def test_only_changed_days_are_checked_again(spark, tmp_path):
    from tradewell.operators.quality import duplicate_keys
    from tradewell.plans.checks import PartCheck

    days = PartTable(spark, str(tmp_path / "d"), StructType().add("k", IntegerType()).add("d", DateType()), column="d")
    findings = StructType().add("d", DateType()).add("k", IntegerType()).add("filas", "long")
    read = []

    def check(rows_):
        read.append({r[0].day for r in rows_.select("d").distinct().collect()})
        return duplicate_keys(rows_, ["d", "k"])

    def frame(*pairs):
        return spark.createDataFrame([(k, date(2025, 3, x)) for k, x in pairs], "k int, d date")

    def day(x):
        return days.part_of(date(2025, 3, x))

    def checker(signature="a"):
        return PartCheck(days, str(tmp_path / "c"), findings, check, signature)

    assert checker().run() == [] and checker().report().count() == 0
    days.replace(frame((1, 1), (1, 1), (2, 2), (3, 3), (3, 3), (3, 3)))
    assert checker().run() == [day(1), day(2), day(3)] and checker().run() == []
    days.replace(frame((2, 2), (2, 2)), gone=[day(3)])
    days.append(frame((5, 4), (5, 4)))
    assert checker().run() == [day(2), day(4)]
    assert rows(checker().report()) == rows(duplicate_keys(days.read(), ["d", "k"]).select("d", "k", "filas"))
    days.replace(frame((1, 1)))
    assert checker().run() == [day(1)] and rows(checker().report().select("k")) == [(2,), (5,)]
    assert read[1:] == [{1, 2, 3}, {2, 4}, {1}]
    assert checker("b").run() == [day(1), day(2), day(4)]
    with pytest.raises(ValueError):
        PartCheck(days, str(tmp_path / "c"), StructType().add("k", IntegerType()), check)
