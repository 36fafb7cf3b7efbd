"""Plans and results under skew: a third of all rows on one key."""

from __future__ import annotations

import re
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from driver_queries.frames import QUERIES
from driver_queries.stored import land_lines
from tests.conftest import rows
from tradewell.operators import enrich, keys, merge, scd2
from tradewell.operators.sizing import estimated_bytes
from tradewell.plans import marts
from tradewell.plans.store import Warehouse
from tradewell.session import size_shuffles

FOLDER = "/root/testdata/sf0.001"


def executed(df):
    """The plan as it ran, after adaptive re-planning."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def initial(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tight(spark):
    """Thresholds at which test data behaves like large data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32kb",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16kb",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def skewed(spark):
    """60,000 lines; product 0 holds more than a third of them."""
    return spark.range(60000, numPartitions=8).select(
        F.col("id").alias("linea"), F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 997).alias("producto"),
        F.date_add(F.lit(date(2025, 1, 1)), (F.col("id") % 300).cast("int")).alias("fecha_sk"),
    )


def test_lookup_of_a_hot_key_is_split(spark, tight, skewed):
    products = spark.range(997).select(F.col("id").alias("codigo"), (F.col("id") + 1).alias("id_producto"))
    out = enrich.enrich(skewed, [enrich.Dimension(products, {"producto": "codigo"}, "id_producto", "id_producto_fk")])
    plan = executed(out.select("linea", "id_producto_fk", enrich.REASON))
    assert "skew=true" in plan
    assert out.filter(F.col("id_producto_fk") == F.col("producto") + 1).count() == 60000


def test_rows_without_a_key_are_split_too(spark, tight, skewed):
    lost = skewed.withColumn("producto", F.when(F.col("producto") > 0, F.col("producto")))
    products = spark.range(997).select(F.col("id").alias("codigo"), (F.col("id") + 1).alias("id_producto"))
    out = enrich.enrich(lost, [enrich.Dimension(products, {"producto": "codigo"}, "id_producto", "id_producto_fk")])
    assert out.filter(F.col(enrich.REASON) == "id_producto_fk").count() == skewed.filter("producto = 0").count()


def test_reports_reduce_a_hot_key_before_the_shuffle(spark, tight, skewed):
    products = spark.range(997).select(F.col("id").alias("codigo"), (F.col("id") % 3).alias("grupo"))
    out = marts.sums_by(skewed, {"n": F.lit(1)}, [marts.Star(products, "producto", "codigo", {"grupo": "grupo"})], ["grupo"])
    plan = initial(out)
    assert plan.index("Join") < plan.index("partial_sum(1)")  # printed from the top: summed below the join
    assert rows(out.agg(F.sum("lineas"))) == [(60000,)]


def test_versions_of_a_hot_key_are_compared_by_year(spark, tight):
    history = spark.range(3650).select(
        F.lit("v").alias("k"), F.date_add(F.lit(date(2015, 1, 1)), F.col("id").cast("int")).alias("ini"),
        F.date_add(F.lit(date(2015, 1, 1)), F.col("id").cast("int")).alias("fin"), F.col("id").alias("rol"))
    fact = history.select(F.col("k").alias("s"), F.col("ini").alias("f"))
    out = scd2.point_in_time(fact, history, {"s": "k"}, "f", "ini", "fin", {"rol": "rol"}, scd2.day_window(fact, "f"), True)
    assert out.filter("rol IS NOT NULL").count() == 3650 and out.select("rol").distinct().count() == 3650
    assert "__year" in initial(out).split("Join")[1].split("\n")[0]


def test_overlap_report_of_a_hot_key_sees_days_not_versions(spark):
    history = spark.range(50000).select(
        F.lit("v").alias("k"), F.date_add(F.lit(date(2025, 1, 1)), (F.col("id") % 30).cast("int")).alias("ini"),
        F.lit(date(2025, 12, 31)).alias("fin"))
    report = scd2.overlap_report(history, ["k"], "ini", "fin")
    assert report.count() == 30
    plan = initial(report)
    assert plan.index("Window") < plan.index("partial_count")


def test_bucketed_dimension_is_not_shuffled_for_a_merge(spark, tight, tmp_path):
    wh = Warehouse(spark, "bucketed", str(tmp_path), {"maestro_personas": 8})
    people = spark.range(1000).select(
        F.col("id").alias("id_persona"), F.col("id").cast("string").alias("numero_documento"), F.lit("x").alias("nombre_completo"))
    stored = wh.publish("maestro_personas", people)
    merged = merge.upsert(stored, people.limit(500).withColumn("nombre_completo", F.lit("y")), ["numero_documento"])
    assert merged.filter("nombre_completo = 'y'").count() == 500 and merged.count() == 1000
    side = re.split(r"SortMergeJoin", initial(merged))[1]
    assert side.index("Bucketed: true") < side.index("Exchange")  # the stored side has no exchange of its own


def test_shuffle_partitions_follow_the_input(spark):
    assert size_shuffles(spark, 1 << 20) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert size_shuffles(spark, 1 << 40) == 4096
    assert size_shuffles(spark, 100 << 40) == 100 << 12
    size_shuffles(spark, 0)


def test_lines_of_a_large_company_are_many_files(spark, tight, tmp_path):
    lines = spark.range(40000, numPartitions=8).select(
        F.when(F.col("id") % 100 == 0, "F").otherwise("O").alias("empresa"), F.sha2(F.col("id").cast("string"), 256).alias("texto"))
    folders = land_lines(lines, "empresa", "texto", str(tmp_path / "lineas"))
    assert len(spark.read.text(folders["O"]).inputFiles()) > 8
    assert [spark.read.text(folders[c]).distinct().count() for c in "FO"] == [400, 39600]


def test_landed_lines_are_compressed_and_not_shuffled(spark, tmp_path):
    lines = spark.range(30000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, "F").otherwise("P").alias("empresa"), F.format_string('{"NUMFACTURA":"%d","CANT":"1.00"}', "id").alias("texto"))
    folders = land_lines(lines, "empresa", "texto", str(tmp_path / "lineas"))
    files = [p for p in (tmp_path / "lineas").rglob("part-*")]
    assert files and sum(p.stat().st_size for p in files) * 3 < 30000 * 35
    assert [spark.read.text(folders[c]).distinct().count() for c in "FP"] == [10000, 20000]
    assert len(files) <= 8  # two companies in each of four tasks


def test_rows_resolved_together_are_stored_as_columns(spark, tight, tmp_path):
    """A checkpoint holds rows as they are in memory."""
    fact = spark.range(5000).select("id", *[(F.col("id") % 7).cast("string").alias(c) for c in "abc"], F.repeat(F.lit("x"), 400).alias("texto"))
    dims = [enrich.Dimension(spark.range(7).select(F.col("id").cast("string").alias("k"), (F.col("id") + 1).alias("v")), {c: "k"}, "v", f"{c}_fk") for c in "abc"]
    out = enrich.enrich(fact, dims)
    assert "Scan ExistingRDD" not in initial(out) and len(out.filter("a_fk = id % 7 + 1 AND c_fk = a_fk AND length(texto) = 400").collect()) == 5000
    (folder,) = {re.sub(r"^file:(.*)/[^/]*$", r"\1", f) for f in out.inputFiles()}
    assert sum(p.stat().st_size for p in Path(folder).glob("*.parquet")) < 5000 * 100


def test_shuffles_are_sized_by_rows_in_memory(spark, monkeypatch):
    """Files hold columns, compressed; the tasks of a shuffle hold rows."""
    asked = []
    monkeypatch.setattr(registered, "size_shuffles", lambda spark_, n: asked.append(n) or size_shuffles(spark_, n))
    registered.queries()["mart_product_state_asof"](spark, FOLDER)
    assert asked == [8 * estimated_bytes(registered.table(spark, FOLDER, "lineitem"))]
    assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == 32 << 20


def test_ids_of_many_new_rows(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"), F.lit(None).cast("bigint").alias("id"))
    out = keys.assign_ids(df, ["k"], "id")
    assert rows(out.agg(F.min("id"), F.max("id"), F.countDistinct("id"))) == [(1, 20000, 20000)]
    assert rows(out.filter("k = '17'")) == rows(keys.assign_ids(df.repartition(3), ["k"], "id").filter("k = '17'"))


@pytest.mark.parametrize("broadcasts", [True, False])
def test_no_query_joins_without_a_key(spark, broadcasts):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not broadcasts:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, query in QUERIES.items():
            plan = initial(query(spark, FOLDER))
            assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), name
            assert not re.search("PythonUDF|MapInPandas|BatchEvalPython", plan), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_filters_and_columns_reach_the_scan(spark):
    plan = initial(registered.queries()["audit_clients_pending"](spark, FOLDER))
    orders = next(line for line in plan.splitlines() if "orders.parquet" in line)
    assert "GreaterThanOrEqual(o_orderdate" in orders and "o_totalprice" not in orders
