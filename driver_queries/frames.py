"""Warehouse-shaped frames derived from the driver's tables, and the same in SQL.

Three order states stand for three companies, suppliers for sellers, customers for clients,
parts for products, nations for warehouses. Missing keys come from attributes of the rows
(size, balance, region), so every query runs over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewell.functions.text import blank_to
from tradewell.operators.enrich import Dimension, History, enrich
from tradewell.plans.marts import Star, sums_by

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2001-08-01"  # the last order day; never the clock


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the footers once per path."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def money(column: str | Column, precision: int = 12, scale: int = 2) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast(f"decimal({precision},{scale})")


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- sales lines -----------------------------------------------------------------

def sales(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    base = money("l_extendedprice") * (F.lit(1).cast("decimal(3,2)") - money("l_discount", 3))
    reference = F.when(F.col("l_returnflag") == "N", F.lit(None)).when(
        F.col("l_returnflag") == "A", F.lit("")
    ).otherwise(F.col("l_partkey").cast("string"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("numero_factura_erp"),
        F.col("l_shipdate").cast("date").alias("fecha_envio"),
        F.col("o_orderdate").cast("date").alias("fecha_sk"),
        F.col("o_orderstatus").alias("empresa_erp"),
        F.col("l_partkey").alias("codigo_producto_erp"),
        blank_to(reference, F.col("l_partkey").cast("string")).alias("referencia_erp"),
        F.col("o_custkey").alias("cod_cliente_erp"),
        F.col("l_suppkey").alias("cod_vendedor_erp"),
        F.lpad((F.col("l_tax") * 100 + 0.5).cast("int").cast("string"), 2, "0").alias("bodega_erp"),
        money("l_quantity").alias("cantidad"),
        base.alias("valor_base"),
        F.col("l_returnflag").alias("marca_devolucion"),
        F.col("l_linestatus").alias("estado_linea"),
    )


SALES = """
sales AS (
  SELECT l_orderkey AS numero_factura_erp, CAST(l_shipdate AS DATE) AS fecha_envio,
         CAST(o_orderdate AS DATE) AS fecha_sk, o_orderstatus AS empresa_erp,
         l_partkey AS codigo_producto_erp, CAST(l_partkey AS VARCHAR) AS referencia_erp,
         o_custkey AS cod_cliente_erp, l_suppkey AS cod_vendedor_erp,
         lpad(CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR), 2, '0') AS bodega_erp,
         CAST(l_quantity AS DECIMAL(12,2)) AS cantidad,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2)))
           AS valor_base,
         l_returnflag AS marca_devolucion, l_linestatus AS estado_linea
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


# --- dimensions with gaps ----------------------------------------------------------

def products(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of the largest size are not in the catalog."""
    return table(spark, folder, "part").filter(F.col("p_size") < 50).select(
        (F.col("p_partkey") + 1).alias("id_producto"),
        F.col("p_partkey").alias("codigo_erp"),
        blank_to(F.when(F.col("p_size") > 25, F.col("p_partkey").cast("string")),
                 F.col("p_partkey").cast("string")).alias("referencia"),
        F.col("p_name").alias("descripcion_erp"),
        F.col("p_type").alias("cod_linea_erp"),
        F.col("p_brand").alias("cod_marca_erp"),
    )


def clients(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in debt are not registered; link to the master only above 7000."""
    return table(spark, folder, "customer").filter(F.col("c_acctbal") >= 0).select(
        (F.col("c_custkey") + 1).alias("id_cliente_empresa"),
        F.col("c_custkey").alias("cod_cliente_erp"),
        F.when(F.col("c_acctbal") > 7000, F.col("c_custkey") + 1000).alias("id_maestro_cliente_fk"),
        F.concat(F.lit("N-"), F.col("c_custkey").cast("string")).alias("nit"),
        F.col("c_name").alias("nombre_erp"),
        F.col("c_mktsegment").alias("empresa_erp"),
    )


def warehouses(spark: SparkSession, folder: str) -> DataFrame:
    """Nations of the last region have no warehouse."""
    return table(spark, folder, "nation").filter(F.col("n_regionkey") < 4).select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("id_bodega"),
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("cod_bodega_erp"),
        F.col("n_name").alias("nombre_bodega"),
    )


def roles(spark: SparkSession, folder: str) -> DataFrame:
    """Two role versions per seller and company.

    The first ends on a day that depends on seller and company; sellers in debt have only the
    second, which ends with the year 2000 for the richest.
    """
    sellers = table(spark, folder, "supplier").select(
        "s_suppkey", "s_acctbal",
        F.inline(F.array(*[
            F.struct(F.lit(code).alias("empresa_erp"), F.lit(i).alias("__i"))
            for i, code in enumerate(("F", "O", "P"))
        ])),
    ).withColumn("__cut", F.date_add(
        day("1998-01-01"), (F.col("s_suppkey") % 365).cast("int") + F.col("__i") * 30))
    first = F.struct(
        (F.col("s_suppkey") * 6 + F.col("__i") * 2).alias("id_rol_historia"),
        day("1900-01-01").alias("fecha_inicio_validez"),
        F.date_sub("__cut", 1).alias("fecha_fin_validez"),
    )
    second = F.struct(
        (F.col("s_suppkey") * 6 + F.col("__i") * 2 + 1).alias("id_rol_historia"),
        F.col("__cut").alias("fecha_inicio_validez"),
        F.when(F.col("s_acctbal") > 9000, day("2000-12-31")).otherwise(day("9999-12-31"))
        .alias("fecha_fin_validez"),
    )
    versions = F.array_compact(F.array(F.when(F.col("s_acctbal") >= 0, first), second))
    return sellers.select(F.col("s_suppkey").alias("cod_rol_erp"), "empresa_erp", F.inline(versions))


PRODUCTS = """
products AS (
  SELECT p_partkey + 1 AS id_producto, p_partkey AS codigo_erp, CAST(p_partkey AS VARCHAR) AS referencia,
         p_name AS descripcion_erp, p_type AS cod_linea_erp, p_brand AS cod_marca_erp
  FROM part WHERE p_size < 50)"""
CLIENTS = """
clients AS (
  SELECT c_custkey + 1 AS id_cliente_empresa, c_custkey AS cod_cliente_erp,
         CASE WHEN c_acctbal > 7000 THEN c_custkey + 1000 END AS id_maestro_cliente_fk,
         'N-' || c_custkey AS nit, c_name AS nombre_erp, c_mktsegment AS empresa_erp
  FROM customer WHERE c_acctbal >= 0)"""
WAREHOUSES = """
warehouses AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id_bodega, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS cod_bodega_erp,
         n_name AS nombre_bodega
  FROM nation WHERE n_regionkey < 4)"""
ROLES = """
sellers AS (
  SELECT s_suppkey, s_acctbal, empresa_erp, i,
         CAST(DATE '1998-01-01' + CAST(s_suppkey % 365 + i * 30 AS INTEGER) AS DATE) AS cut
  FROM supplier, (VALUES ('F', 0), ('O', 1), ('P', 2)) AS e(empresa_erp, i)),
roles AS (
  SELECT s_suppkey AS cod_rol_erp, empresa_erp, s_suppkey * 6 + i * 2 AS id_rol_historia,
         DATE '1900-01-01' AS fecha_inicio_validez, CAST(cut - 1 AS DATE) AS fecha_fin_validez
  FROM sellers WHERE s_acctbal >= 0
  UNION ALL
  SELECT s_suppkey, empresa_erp, s_suppkey * 6 + i * 2 + 1, cut,
         CASE WHEN s_acctbal > 9000 THEN DATE '2000-12-31' ELSE DATE '9999-12-31' END
  FROM sellers)"""


# --- the enriched fact ---------------------------------------------------------------

def role_lookup(spark: SparkSession, folder: str) -> History:
    # Two dates, read once: as subqueries they would read the orders again in every place they stand.
    first, last = table(spark, folder, "orders").agg(
        F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    return History(
        roles(spark, folder), {"cod_vendedor_erp": "cod_rol_erp", "empresa_erp": "empresa_erp"},
        "id_rol_historia", "id_rol_historia_fk", window=(F.lit(first), F.lit(last)), by_year=True,
    )


def enriched_sales(spark: SparkSession, folder: str) -> DataFrame:
    return enrich(sales(spark, folder), [
        Dimension(products(spark, folder),
                  {"codigo_producto_erp": "codigo_erp", "referencia_erp": "referencia"},
                  "id_producto", "id_producto_fk", {"cod_linea_erp": "cod_linea_erp"}),
        Dimension(clients(spark, folder), {"cod_cliente_erp": "cod_cliente_erp"},
                  "id_cliente_empresa", "id_cliente_empresa_fk"),
        role_lookup(spark, folder),
        Dimension(warehouses(spark, folder), {"bodega_erp": "cod_bodega_erp"},
                  "id_bodega", "id_bodega_fk"),
    ])


ENRICHED = f"""{SALES},{PRODUCTS},{CLIENTS},{WAREHOUSES},{ROLES},
enriched AS (
  SELECT s.*, p.id_producto AS id_producto_fk, p.cod_linea_erp, c.id_cliente_empresa AS id_cliente_empresa_fk,
         r.id_rol_historia AS id_rol_historia_fk, w.id_bodega AS id_bodega_fk,
         CASE WHEN p.id_producto IS NULL THEN 'id_producto_fk'
              WHEN c.id_cliente_empresa IS NULL THEN 'id_cliente_empresa_fk'
              WHEN r.id_rol_historia IS NULL THEN 'id_rol_historia_fk'
              WHEN w.id_bodega IS NULL THEN 'id_bodega_fk' END AS motivo_rechazo
  FROM sales s
  LEFT JOIN products p ON p.codigo_erp = s.codigo_producto_erp AND p.referencia = s.referencia_erp
  LEFT JOIN clients c ON c.cod_cliente_erp = s.cod_cliente_erp
  LEFT JOIN roles r ON r.cod_rol_erp = s.cod_vendedor_erp AND r.empresa_erp = s.empresa_erp
        AND s.fecha_sk BETWEEN r.fecha_inicio_validez AND r.fecha_fin_validez
  LEFT JOIN warehouses w ON w.cod_bodega_erp = s.bodega_erp)"""


# --- stock ---------------------------------------------------------------------------

def shipped(
    spark: SparkSession, folder: str, since: str | None = None, before: str | None = None
) -> DataFrame:
    """Quantity shipped in a span of days by part and supplier nation."""
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, folder, "lineitem")
    if since:
        lines = lines.filter(F.col("l_shipdate").cast("date") >= day(since))
    if before:
        lines = lines.filter(F.col("l_shipdate").cast("date") < day(before))
    return sums_by(
        lines, {"cantidad": money("l_quantity")},
        [Star(suppliers, "l_suppkey", "s_suppkey", {"s_nationkey": "s_nationkey"})],
        ["l_partkey", "s_nationkey"], {"l_partkey": F.col("l_partkey")},
    ).drop("lineas")


SHIPPED = """
shipped AS (
  SELECT l_partkey, s_nationkey, CAST(l_shipdate AS DATE) AS dia,
         SUM(CAST(l_quantity AS DECIMAL(12,2))) AS cantidad
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"""
