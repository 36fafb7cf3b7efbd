"""Write modes and key lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.frames import (
    CLIENTS, SHIPPED, clients, day, doubles, money, products, query, shipped, table, warehouses,
)
from tradewell.functions import text
from tradewell.operators import keys, lookup, merge
from tradewell.plans.marts import Star, sums_by
from tradewell.session import ensure_checkpoint_dir

LAST_ORDER = """SELECT o_custkey AS cliente, fecha, o_orderpriority AS prioridad, valor FROM (
    SELECT *, CAST(o_orderdate AS DATE) AS fecha, CAST(o_totalprice AS DECIMAL(12,2)) AS valor,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders WHERE {where}) WHERE rn = 1"""


def _last_order(spark, folder, condition):
    """Each customer's latest order among those that meet the condition."""
    orders = table(spark, folder, "orders").filter(condition).select(
        F.col("o_custkey").alias("cliente"), F.col("o_orderdate").cast("date").alias("fecha"),
        "o_orderkey", F.col("o_orderpriority").alias("prioridad"),
        money("o_totalprice").alias("valor"),
    )
    return keys.pick_one(orders, ["cliente"], ["fecha", "o_orderkey"]).drop("o_orderkey")


@query("upsert_full", f"""
WITH t AS ({LAST_ORDER.format(where="o_orderdate < DATE '1998-06-01'")}),
     s AS ({LAST_ORDER.format(where="o_orderdate >= DATE '1998-06-01'")})
SELECT COALESCE(s.cliente, t.cliente) AS cliente,
       CASE WHEN s.cliente IS NOT NULL THEN s.fecha ELSE t.fecha END AS fecha,
       CASE WHEN s.cliente IS NOT NULL THEN s.prioridad ELSE t.prioridad END AS prioridad,
       CAST(CASE WHEN s.cliente IS NOT NULL THEN s.valor ELSE t.valor END AS DOUBLE) AS valor
FROM t FULL JOIN s ON s.cliente = t.cliente""")
def upsert_full(spark, folder):
    placed = F.col("o_orderdate").cast("date")
    # Both are stored, as a table and the feed of a job are: a merge reads them twice.
    ensure_checkpoint_dir(spark)
    target = _last_order(spark, folder, placed < day("1998-06-01")).checkpoint()
    source = _last_order(spark, folder, placed >= day("1998-06-01")).checkpoint()
    return doubles(merge.upsert(target, source, ["cliente"]), "valor")


@query("upsert_partial", """
WITH t AS (SELECT p_partkey, p_name, p_size, CAST(p_retailprice AS DECIMAL(12,2)) AS precio FROM part WHERE p_size <= 30),
s AS (SELECT p_partkey, p_name || ' (2)' AS p_name, p_size + 100 AS p_size,
             CAST(CAST(p_retailprice AS DECIMAL(12,2)) + 5 AS DECIMAL(12,2)) AS precio FROM part WHERE p_size >= 20)
SELECT COALESCE(t.p_partkey, s.p_partkey) AS p_partkey, COALESCE(s.p_name, t.p_name) AS p_name,
       COALESCE(t.p_size, s.p_size) AS p_size, CAST(COALESCE(s.precio, t.precio) AS DOUBLE) AS precio
FROM t FULL JOIN s ON s.p_partkey = t.p_partkey""")
def upsert_partial(spark, folder):
    parts = table(spark, folder, "part").select(
        "p_partkey", "p_name", "p_size", money("p_retailprice").alias("precio")
    )
    source = parts.filter(F.col("p_size") >= 20).withColumns({
        "p_name": F.concat("p_name", F.lit(" (2)")), "p_size": F.col("p_size") + 100,
        "precio": (F.col("precio") + 5).cast("decimal(12,2)"),
    })
    # Name and price follow the feed, the size stays as first inserted.
    merged = merge.upsert(
        parts.filter(F.col("p_size") <= 30), source, ["p_partkey"], ["p_name", "precio"]
    )
    return doubles(merged, "precio")


@query("upsert_insert_ignore", """
WITH t AS (SELECT p_brand || '/' || p_type AS cod, MIN(p_name) AS nombre FROM part WHERE p_size <= 2 GROUP BY 1),
s AS (SELECT p_brand || '/' || p_type AS cod, p_name AS nombre,
             row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rn FROM part)
SELECT * FROM t UNION ALL
SELECT cod, nombre FROM s WHERE rn = 1 AND cod NOT IN (SELECT cod FROM t)""")
def upsert_insert_ignore(spark, folder):
    parts = table(spark, folder, "part").withColumn("cod", F.concat_ws("/", "p_brand", "p_type"))
    target = parts.filter(F.col("p_size") <= 2).groupBy("cod").agg(F.min("p_name").alias("nombre"))
    # The feed repeats codes; the first row of a code counts.
    source = keys.pick_one(
        parts.select("cod", "p_partkey", F.col("p_name").alias("nombre")),
        ["cod"], ["p_partkey"], keep="first",
    )
    return merge.insert_ignore(target, source, ["cod"])


@query("link_fill_null", f"""
WITH {CLIENTS},
m AS (SELECT c_custkey AS cod_cliente_maestro, c_custkey + 5000000 AS id_maestro_cliente
      FROM customer WHERE c_nationkey < 20)
SELECT c.cod_cliente_erp, COALESCE(c.id_maestro_cliente_fk, m.id_maestro_cliente) AS id_maestro_cliente_fk
FROM clients c LEFT JOIN m ON m.cod_cliente_maestro = c.cod_cliente_erp""")
def link_fill_null(spark, folder):
    master = table(spark, folder, "customer").filter(F.col("c_nationkey") < 20).select(
        F.col("c_custkey").alias("cod_cliente_maestro"),
        (F.col("c_custkey") + 5000000).alias("id_maestro_cliente"),
    )
    linked = clients(spark, folder).select("cod_cliente_erp", "id_maestro_cliente_fk")
    return lookup.fill_null(
        linked, master, {"cod_cliente_erp": "cod_cliente_maestro"},
        "id_maestro_cliente_fk", "id_maestro_cliente",
    )


OLD_STOCK = """old AS (
  SELECT l_partkey AS producto, s_nationkey AS bodega, CAST(SUM(cantidad) AS DOUBLE) AS cantidad
  FROM shipped WHERE dia < DATE '1998-06-01' GROUP BY ALL)"""
NEW_STOCK = """fresh AS (
  SELECT l_partkey AS producto, s_nationkey AS bodega, CAST(SUM(cantidad) AS DOUBLE) AS cantidad
  FROM shipped WHERE dia >= DATE '1998-06-01' GROUP BY ALL)"""


def _stock(spark, folder, **span):
    return shipped(spark, folder, **span).select(
        F.col("l_partkey").alias("producto"), F.col("s_nationkey").alias("bodega"),
        F.col("cantidad").cast("double").alias("cantidad"),
    )


@query("inventory_current", f"""
WITH {SHIPPED}, {OLD_STOCK}, {NEW_STOCK},
s AS (
  SELECT p.p_partkey + 1 AS id_producto_fk, CAST(n.n_nationkey + 1 AS BIGINT) AS id_bodega_fk, f.cantidad
  FROM fresh f JOIN part p ON p.p_partkey = f.producto AND p.p_size < 50
  JOIN nation n ON n.n_nationkey = f.bodega AND n.n_regionkey < 4),
t AS (SELECT producto + 1 AS id_producto_fk, CAST(bodega + 1 AS BIGINT) AS id_bodega_fk, cantidad FROM old)
SELECT COALESCE(s.id_producto_fk, t.id_producto_fk) AS id_producto_fk,
       COALESCE(s.id_bodega_fk, t.id_bodega_fk) AS id_bodega_fk, COALESCE(s.cantidad, t.cantidad) AS cantidad,
       CASE WHEN s.id_producto_fk IS NULL THEN DATE '1996-01-01' ELSE DATE '2001-08-01' END AS fecha
FROM s FULL JOIN t USING (id_producto_fk, id_bodega_fk)""")
def inventory_current(spark, folder):
    old = _stock(spark, folder, before="1998-06-01").select(
        (F.col("producto") + 1).alias("id_producto_fk"),
        (F.col("bodega") + 1).cast("bigint").alias("id_bodega_fk"), "cantidad",
        day("1996-01-01").alias("fecha"),
    )
    feed = _stock(spark, folder, since="1998-06-01").withColumns({
        "__code": F.lpad(F.col("bodega").cast("string"), 2, "0"),
        "__ref": F.col("producto").cast("string"), "fecha": day("2001-08-01"),
    })
    resolved = lookup.lookup(
        feed, products(spark, folder), {"producto": "codigo_erp", "__ref": "referencia"},
        {"id_producto": "id_producto_fk"},
    )
    resolved = lookup.lookup(
        resolved, warehouses(spark, folder), {"__code": "cod_bodega_erp"},
        {"id_bodega": "id_bodega_fk"},
    ).dropna(subset=["id_producto_fk", "id_bodega_fk"])
    return merge.upsert(
        old, resolved.select(*old.columns), ["id_producto_fk", "id_bodega_fk"]
    )


@query("inventory_snapshot_append", f"""
WITH {SHIPPED}, {OLD_STOCK}, {NEW_STOCK},
h AS (SELECT producto, bodega, cantidad, CASE WHEN cantidad > 40 THEN DATE '2001-08-01' ELSE DATE '1996-01-01' END AS fecha_snapshot FROM old)
SELECT * FROM h
UNION ALL
SELECT f.producto, f.bodega, f.cantidad, DATE '2001-08-01' FROM fresh f
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.fecha_snapshot = DATE '2001-08-01'
                  AND h.producto = f.producto AND h.bodega = f.bodega)""")
def inventory_snapshot_append(spark, folder):
    # Part of the history is a snapshot of that very day.
    history = _stock(spark, folder, before="1998-06-01").withColumn(
        "fecha_snapshot", F.when(F.col("cantidad") > 40, day("2001-08-01")).otherwise(day("1996-01-01"))
    )
    current = _stock(spark, folder, since="1998-06-01")
    return merge.append_snapshot(
        history, current, ["producto", "bodega"], "fecha_snapshot", day("2001-08-01")
    )


@query("mapping_override", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'LINEA ' || p_brand ELSE p_type END AS linea FROM part""")
def mapping_override(spark, folder):
    parts = table(spark, folder, "part")
    entries = F.array(
        F.struct(F.lit(1).alias("orden"), F.lit("ANTERIOR").alias("corregido")),
        F.struct(F.lit(2).alias("orden"), F.concat(F.lit("LINEA "), F.col("p_brand")).alias("corregido")),
    )
    # Every corrected part is in the mapping twice; the later entry wins.
    mapping = parts.filter(F.col("p_size") > 40).select(F.col("p_partkey").alias("codigo"), F.inline(entries))
    return lookup.override(
        parts.select("p_partkey", F.col("p_type").alias("linea")),
        lookup.last_mapping(mapping, ["codigo"], "orden"), {"p_partkey": "codigo"},
        "linea", "corregido",
    )


@query("mapping_composite", """
WITH m AS (SELECT p_brand, p_type, COUNT(*) AS cod FROM part WHERE p_size <= 3 GROUP BY ALL)
SELECT p_partkey, cod FROM part LEFT JOIN m USING (p_brand, p_type)""")
def mapping_composite(spark, folder):
    parts = table(spark, folder, "part")
    mapping = parts.filter(F.col("p_size") <= 3).groupBy("p_brand", "p_type").agg(
        F.count("*").alias("cod")
    )
    return lookup.lookup(
        parts, mapping, {"p_brand": "p_brand", "p_type": "p_type"}, {"cod": "cod"}
    ).select("p_partkey", "cod")


@query("lookup_first_match", """
WITH f AS (SELECT p_brand, p_type, MIN(p_partkey) AS primero FROM part GROUP BY ALL)
SELECT p_partkey, primero FROM part JOIN f USING (p_brand, p_type)""")
def lookup_first_match(spark, folder):
    parts = table(spark, folder, "part")
    first = lookup.first_match(parts, ["p_brand", "p_type"], "p_partkey")
    return lookup.lookup(
        parts, first, {"p_brand": "p_brand", "p_type": "p_type"}, {"p_partkey": "primero"}
    ).select("p_partkey", "primero")


@query("lookup_role_playing", """
SELECT cn.n_name AS nacion_cliente, sn.n_name AS nacion_vendedor, COUNT(*) AS lineas
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey
GROUP BY ALL""")
def lookup_role_playing(spark, folder):
    nations = table(spark, folder, "nation")
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    # One lookup table in two roles.
    return sums_by(lines, {}, [
        Star(table(spark, folder, "customer"), "o_custkey", "c_custkey", {"c_nationkey": "__cn"}),
        Star(table(spark, folder, "supplier"), "l_suppkey", "s_suppkey", {"s_nationkey": "__sn"}),
        Star(nations, "__cn", "n_nationkey", {"n_name": "nacion_cliente"}),
        Star(nations, "__sn", "n_nationkey", {"n_name": "nacion_vendedor"}),
    ], ["nacion_cliente", "nacion_vendedor"])


@query("surrogate_keys", """
WITH c AS (SELECT c_custkey, c_acctbal FROM customer)
SELECT COUNT(*) AS filas, COUNT(*) AS ids, MAX(CASE WHEN c_acctbal >= 0 THEN c_custkey + 1 END)
         + COUNT(*) FILTER (c_acctbal < 0) AS id_mayor,
       COUNT(*) FILTER (c_acctbal < 0) AS nuevas, CAST(0 AS BIGINT) AS cambiadas
FROM c""")
def surrogate_keys(spark, folder):
    """Registered customers keep their id, the others get the numbers after the largest."""
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_custkey") + 1).alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey") + 1).alias("antes"),
    )
    numbered = keys.assign_ids(customers, ["c_custkey"], "id")
    return numbered.agg(
        F.count("*").alias("filas"), F.countDistinct("id").alias("ids"), F.max("id").alias("id_mayor"),
        F.count_if(F.col("antes").isNull()).alias("nuevas"),
        F.count_if(F.col("antes") != F.col("id")).alias("cambiadas"),
    )


@query("text_standardise", """
SELECT c_custkey, upper(c_name) AS nombre,
       CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_custkey AS VARCHAR) ELSE c_mktsegment END AS referencia,
       c_name LIKE 'Customer%' AS es_cliente
FROM customer""")
def text_standardise(spark, folder):
    padded = F.concat(F.lit(" \t"), F.lower("c_name"), F.lit("\n "))
    emptied = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return table(spark, folder, "customer").select(
        "c_custkey", text.standard_text(padded).alias("nombre"),
        text.blank_to(emptied, F.col("c_custkey").cast("string")).alias("referencia"),
        F.initcap(text.strip_text(padded)).startswith("Customer").alias("es_cliente"),
    )


@query("date_parse_lenient", """
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '31/' || strftime(o_orderdate, '%m/%Y')
                WHEN o_orderstatus = 'P' THEN extract(day FROM o_orderdate) || '/' || extract(month FROM o_orderdate)
                     || '/' || extract(year FROM o_orderdate)
                ELSE strftime(o_orderdate, '%d/%m/%Y') END AS texto FROM orders)
SELECT o_orderkey, texto, CAST(try_strptime(texto, '%d/%m/%Y') AS DATE) AS fecha FROM f""")
def date_parse_lenient(spark, folder):
    placed = F.col("o_orderdate").cast("date")
    written = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("31/"), F.date_format(placed, "MM/yyyy")))
        .when(F.col("o_orderstatus") == "P", F.date_format(placed, "d/M/yyyy"))
        .otherwise(F.date_format(placed, "dd/MM/yyyy"))
    )
    return table(spark, folder, "orders").select("o_orderkey", written.alias("texto")).withColumn(
        "fecha", text.feed_date(F.col("texto"))
    )
