"""Dated changes of a history: day by day against the events they come from."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tradewell.operators import keys, scd2

OPEN = date(9999, 12, 31)
HISTORY = "k int, e string, cargo string, nota string, ini date, fin date, id int"
FIRST = date(2025, 1, 1)


def day(n):
    return FIRST + timedelta(n)


def example(seed):
    rng = random.Random(seed)
    history, changes = [], []
    for k in range(60):
        at = rng.randrange(10)
        for _ in range(rng.randrange(4)):
            length = rng.randrange(1, 12)
            last = rng.random() < 0.3
            history.append((k, "X", rng.choice("AB"), f"n{len(history)}", day(at), OPEN if last else day(at + length - 1), len(history) + 1))
            if last:
                break
            at += length + rng.choice([0, 0, 3])
        changes += [(k, "X", rng.choice(["A", "B", None]), day(d)) for d in rng.sample(range(-5, 50), rng.randrange(5))]
    return history, changes


@pytest.mark.parametrize("seed", range(3))
def test_every_day_says_what_the_latest_event_says(spark, sized, seed):
    history, changes = example(seed)
    stored = spark.createDataFrame(history, HISTORY)
    feed = spark.createDataFrame(changes, "k int, e string, cargo string, ini date")
    after = scd2.apply_dated(stored, feed, ["k", "e"], ["cargo"], "ini", "fin", "id")
    assert after.columns == stored.columns
    got = [tuple(r) for r in after.collect()]
    for k in range(60):
        own, mine = [h for h in history if h[0] == k], [c for c in changes if c[0] == k]
        for n in range(-8, 60):
            d = day(n)
            events = [(h[4], 0, h[2], h[5]) for h in own if h[4] <= d]
            for c in mine:
                if c[3] <= d:
                    around = next((h for h in own if h[4] <= c[3] <= h[5]), None)
                    events.append((c[3], 1, c[2], around[5] if around else OPEN))
            latest = max(events, key=lambda e: e[:2], default=None)
            want = [latest[2]] if latest and latest[3] >= d else []
            assert [g[2] for g in got if g[0] == k and g[4] <= d <= g[5]] == want, (k, d)
    ids = {(h[0], h[4]): h[6] for h in history}
    assert {(g[0], g[4]): g[6] for g in got if g[6] is not None} == ids
    notes = {g[3] for g in got if g[6] is None}
    assert None in notes and len(notes) > 1  # split versions carry the untracked column over


def test_second_run_changes_nothing_and_ids_stay(spark):
    history, changes = example(7)
    stored = spark.createDataFrame(history, HISTORY)
    feed = spark.createDataFrame(changes, "k int, e string, cargo string, ini date")

    def run(df):
        out = scd2.apply_dated(df, feed, ["k", "e"], ["cargo"], "ini", "fin", "id")
        return keys.assign_ids(out.checkpoint(), ["k", "e", "ini"], "id", df).checkpoint()

    once = run(stored)
    twice = run(once)
    assert rows(once) == rows(twice) and once.select("id").distinct().count() == once.count()
    assert scd2.upkeep_report(once, twice, ["k", "e"], ["cargo"], "ini", "fin").count() == 0
    report = scd2.upkeep_report(stored, once, ["k", "e"], ["cargo"], "ini", "fin")
    opened = once.join(stored.select("k", "e", "ini"), ["k", "e", "ini"], "left_anti").count()
    assert {r.estado for r in report.select("estado").distinct().collect()} == {"ABIERTA", "CERRADA", "CORREGIDA"}
    assert report.filter("estado = 'ABIERTA'").count() == opened


def test_one_shuffle_by_the_key(spark):
    history, changes = example(1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scd2.apply_dated(
            spark.createDataFrame(history, HISTORY), spark.createDataFrame(changes, "k int, e string, cargo string, ini date"),
            ["k", "e"], ["cargo"], "ini", "fin", "id")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1


def test_nothing_to_do(spark):
    history, changes = example(2)
    stored = spark.createDataFrame(history, HISTORY)
    none = spark.createDataFrame([], "k int, e string, cargo string, ini date")
    assert rows(scd2.apply_dated(stored, none, ["k", "e"], ["cargo"], "ini", "fin", "id")) == rows(stored)
    first = scd2.apply_dated(stored.limit(0), none.union(spark.createDataFrame([(1, "X", "A", FIRST)], none.schema)),
                             ["k", "e"], ["cargo"], "ini", "fin", "id")
    assert rows(first.select("k", "cargo", "ini", "fin", F.col("id").isNull())) == [(1, "A", FIRST, OPEN, True)]
