"""Operators against plain Python on random small data."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tradewell.functions.dates import easter_sunday
from tradewell.operators import keys, merge, scd2

START = date(2025, 1, 1)


def some_day(r):
    return START + timedelta(r.randrange(60))


@pytest.mark.parametrize("seed", [1, 2])
def test_upsert_is_a_dictionary_update(spark, sized, seed):
    r = random.Random(seed)
    target = {k: (r.choice("ab"), r.choice("xy")) for k in r.sample(range(40), 25)}
    source = {k: (r.choice(["c", None]), r.choice("zw")) for k in r.sample(range(40), 15)}
    layout = "k int, a string, b string"
    frames = [spark.createDataFrame([(k, *v) for k, v in d.items()], layout) for d in (target, source)]
    merged = merge.upsert(*frames, ["k"])
    assert {k: (a, b) for k, a, b in rows(merged)} == {**target, **source}
    partial = merge.upsert(*frames, ["k"], ["a"])
    assert {k: (a, b) for k, a, b in rows(partial)} == {
        k: ((source.get(k) or target[k])[0] if k not in source else source[k][0],
            target[k][1] if k in target else source[k][1]) for k in {**target, **source}}
    ignored = merge.insert_ignore(*frames, ["k"])
    assert {k: (a, b) for k, a, b in rows(ignored)} == {**source, **target}


@pytest.mark.parametrize("seed", [3, 4])
def test_last_row_of_a_key(spark, seed):
    r = random.Random(seed)
    data = [(r.randrange(5), r.choice([None, 1, 2, 3]), r.randrange(9)) for _ in range(60)]
    found = keys.pick_one(spark.createDataFrame(data, "k int, o int, v int"), ["k"], ["o"])
    order = {k: max((x for x in data if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, x[2])) for k, _, _ in data}
    assert rows(found) == sorted(order.values(), key=lambda x: [(v is None, str(v)) for v in x])


@pytest.mark.parametrize("seed", [5, 6])
def test_point_in_time_is_the_nested_loop(spark, sized, seed):
    r = random.Random(seed)
    history = []
    for key in "abc":
        day = START
        for _ in range(4):
            day += timedelta(r.randrange(0, 8))
            end = day + timedelta(r.randrange(0, 12))
            history.append((key, len(history), day, end))
            day = end + timedelta(1)
    fact = [(n, r.choice(["a", "b", "c", "d", None]), some_day(r)) for n in range(80)]
    fact_df = spark.createDataFrame(fact, "n int, s string, f date")
    history_df = spark.createDataFrame(history, "k string, id int, ini date, fin date")
    expected = {n: next((i for k, i, a, b in history if k == s and a <= f <= b), None) for n, s, f in fact}
    for by_year in (False, True):
        window = scd2.day_window(fact_df, "f") if by_year else None
        out = scd2.point_in_time(fact_df, history_df, {"s": "k"}, "f", "ini", "fin", {"id": "id"}, window, by_year)
        assert {x.n: x.id for x in out.collect()} == expected and out.count() == len(fact)
    assert scd2.overlap_report(history_df, ["k"], "ini", "fin").filter("estado = 'SOLAPE'").count() == 0


@pytest.mark.parametrize("seed", [7, 8])
def test_overlap_report_is_complete(spark, seed):
    r = random.Random(seed)
    history = [(r.choice("ab"), d, d + timedelta(r.randrange(10))) for d in (some_day(r) for _ in range(14))]
    report = scd2.overlap_report(spark.createDataFrame(history, "k string, ini date, fin date"), ["k"], "ini", "fin")
    found = {(x.k, x.ini) for x in report.filter("estado = 'SOLAPE'").collect()}
    expected = {(k, a) for i, (k, a, b) in enumerate(history) for j, (k2, a2, b2) in enumerate(history)
                if i != j and k == k2 and a2 <= a <= b2}
    assert found == expected


@pytest.mark.parametrize("seed", [9, 10])
def test_change_maintenance_keeps_one_open_version(spark, seed):
    r = random.Random(seed)
    history = spark.createDataFrame([], "k string, v string, ini date, fin date")
    state: dict[str, str] = {}
    for step in range(3):
        feed = {k: r.choice("xyz") for k in r.sample("abcdef", 4)}
        state.update(feed)
        history = scd2.apply_changes(
            history, spark.createDataFrame(list(feed.items()), "k string, v string"), ["k"], ["v"], "ini", "fin",
            F.lit(START + timedelta(10 * step)),
        ).checkpoint()
    opened = history.filter(F.col("fin") == scd2.open_end())
    assert {x.k: x.v for x in opened.collect()} == state and opened.count() == len(state)
    assert scd2.overlap_report(history, ["k"], "ini", "fin").count() == 0  # neither overlaps nor gaps


def test_easter(spark):
    # Published dates of Easter Sunday.
    known = {1818: "03-22", 1961: "04-02", 1981: "04-19", 2000: "04-23", 2008: "03-23", 2019: "04-21", 2024: "03-31", 2025: "04-20",
             2038: "04-25", 2049: "04-18", 2076: "04-19"}
    found = spark.createDataFrame([(y,) for y in known], "y int").select("y", easter_sunday(F.col("y")).alias("e"))
    assert {x.y: x.e.strftime("%m-%d") for x in found.collect()} == known
