"""Feeds, the calendar, comparisons, audits and checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driver_queries.frames import (
    AS_OF, CLIENTS, PRODUCTS, ROLES, SALES, SHIPPED, as_of, clients, day, money, products, query,
    roles, sales, shipped, table,
)
from tradewell.operators import audit, calendar, nested, quality, reconcile, scd2
from tradewell.operators.lookup import lookup
from tradewell.sources import feeds
from tradewell.sources.settings import Company, company_settings

# --- nested and JSON sources ---------------------------------------------------------

EVENT_FEED = feeds.Feed(
    T.StructType([T.StructField("k", T.StringType())]), ("Data", "results"), {"k": "valor_k"}
)


@query("src_json_envelope", """
SELECT event_id, event_type AS empresa_erp, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS valor_k, CAST(2 AS INTEGER) AS posicion
FROM events WHERE value >= 1
UNION ALL SELECT event_id, event_type, NULL, 5 FROM events WHERE value >= 1""")
def src_json_envelope(spark, folder):
    """Each event's JSON text as a payload; small events report an error status."""
    events = table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("empresa_erp"),
        F.concat(
            F.when(F.col("value") < 1, '{"status":"ERROR","').otherwise('{"status":"OK","'),
            F.when(F.col("event_type") == "click", "Data").otherwise("results"),
            # Items that are no records stand among the records.
            F.lit('":["x", 5, '), F.col("props"), F.lit(', [1], null, {"otro": 2}]}'),
        ).alias("texto"),
    )
    return feeds.parse_envelopes(events, "texto", EVENT_FEED, ["event_id", "empresa_erp"])


@query("src_payload_counts", """
SELECT event_type AS empresa_erp, CASE WHEN value < 1 THEN 'ERROR' WHEN value < 2 THEN 'ILEGIBLE' ELSE 'OK' END AS estado,
       COUNT(*) AS archivos, SUM(CASE WHEN value >= 1 AND value < 2 THEN 0 ELSE 3 END)::BIGINT AS elementos,
       SUM(CASE WHEN value >= 1 AND value < 2 THEN 0 ELSE 2 END)::BIGINT AS omitidos
FROM events GROUP BY ALL""")
def src_payload_counts(spark, folder):
    """Payloads by company and state: usable ones, reported errors and pages that are no JSON."""
    events = table(spark, folder, "events").select(
        F.col("event_type").alias("empresa_erp"),
        F.when(F.col("value") < 1, F.concat(F.lit('{"status":"ERROR","results":[1,'), F.col("props"), F.lit(',"x"]}')))
        .when(F.col("value") < 2, "<html>no disponible</html>")
        .otherwise(F.concat(F.lit('{"status":"OK","results":[1,'), F.col("props"), F.lit(',"x"]}'))).alias("texto"),
    )
    counts = feeds.envelope_counts(feeds.parsed(events, "texto", EVENT_FEED, ["empresa_erp"]), EVENT_FEED, ["empresa_erp"])
    return counts.groupBy("empresa_erp", "estado").agg(
        F.count("*").alias("archivos"), F.sum("elementos").alias("elementos"), F.sum("omitidos").alias("omitidos"))


@query("seller_active_filter", """
SELECT 'V' || c_custkey AS cod_cliente_erp, 'N-' || c_custkey AS nit_documento, c_name AS nombre_vendedor,
       c_mktsegment AS empresa_erp
FROM customer WHERE c_acctbal > 2000 AND c_nationkey < 20""")
def seller_active_filter(spark, folder):
    third_parties = table(spark, folder, "customer").select(
        F.when(F.col("c_acctbal") > 2000, F.concat(F.lit("V"), F.col("c_custkey").cast("string")))
        .when(F.col("c_acctbal") >= 0, F.concat(F.lit("S"), F.col("c_custkey").cast("string")))
        .alias("cod_cliente_erp"),
        F.concat(F.lit("N-"), F.col("c_custkey").cast("string")).alias("nit_documento"),
        F.col("c_name").alias("nombre_vendedor"),
        F.when(F.col("c_nationkey") < 20, "0").otherwise("1").alias("inactivo_erp"),
        F.col("c_mktsegment").alias("empresa_erp"),
    )
    return feeds.active_sellers(third_parties)


COMPANIES = [
    Company("A", ("02", "05", "13", "21"), "7"), Company("B", ("04", "17"), "7"), Company("C", ("08",)), Company("D", (), "7"),
]


@query("inventory_flatten", f"""
WITH {SHIPPED}
SELECT CAST(l_partkey AS VARCHAR) AS codigo_erp, CAST(l_partkey AS VARCHAR) AS referencia,
       CASE WHEN p_size <= 20 THEN 'A' WHEN p_size <= 40 THEN 'B' WHEN p_size <= 48 THEN 'C' ELSE 'D' END AS empresa_erp,
       lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS cod_bodega_erp, CAST(SUM(cantidad) AS DOUBLE) AS existencia
FROM shipped JOIN part ON p_partkey = l_partkey
WHERE (p_size <= 20 AND s_nationkey IN (2, 5, 13, 21) AND p_type IN ('PROMO', 'SMALL', 'LARGE'))
   OR (p_size BETWEEN 21 AND 40 AND s_nationkey IN (4, 17) AND p_type IN ('PROMO', 'SMALL', 'LARGE'))
   OR (p_size BETWEEN 41 AND 48 AND s_nationkey = 8)
GROUP BY ALL""")
def inventory_flatten(spark, folder):
    stock = shipped(spark, folder)
    store = F.struct(
        F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("OCODBODEGA"),
        F.col("cantidad").cast("double").alias("OEXISTENCIA"),
    )
    # At most one entry per warehouse in an array.
    nested_stock = stock.groupBy("l_partkey").agg(F.collect_list(store).alias("Bodegas"))
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_type")
    code = F.col("l_partkey").cast("string")

    def lists(*codes):
        return F.array(*[F.struct(F.lit(c).alias("OCODLISTA")) for c in codes])

    feed = nested_stock.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        code.alias("codigo_erp"), code.alias("referencia"),
        F.when(F.col("p_size") <= 20, "A").when(F.col("p_size") <= 40, "B").when(F.col("p_size") <= 48, "C").otherwise("D").alias("empresa_erp"),
        "Bodegas",
        F.when(F.col("p_type").isin("PROMO", "SMALL", "LARGE"), lists("3", " 7 "))
        .when(F.col("p_type") == "ECONOMY", lists("3")).alias("Items"),
    )
    return nested.flatten_stock(feed, company_settings(spark, COMPANIES))


# --- calendar ------------------------------------------------------------------------

MONTHS_SQL = "['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto','Septiembre','Octubre','Noviembre','Diciembre']"
DAYS_SQL = "['Lunes','Martes','Miércoles','Jueves','Viernes','Sábado','Domingo']"
# Easter in the oracle by another method (Meeus/Jones/Butcher) than the library's.
CALENDAR = f"""
days AS (SELECT CAST(UNNEST(generate_series(DATE_TRUNC('year', MIN(o_orderdate)),
           DATE_TRUNC('year', MAX(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM orders),
years AS (SELECT DISTINCT CAST(year(d) AS INTEGER) AS y FROM days),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
e2 AS (SELECT *, (19*a + b - b//4 - ((b - (b+8)//25 + 1)//3) + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2*(b%4) + 2*(c//4) - h - c%4) % 7 AS l FROM e2),
e4 AS (SELECT *, (a + 11*h + 22*l)//451 AS m FROM e3),
easter AS (SELECT y, make_date(y::BIGINT, ((h+l-7*m+114)//31)::BIGINT, ((h+l-7*m+114)%31+1)::BIGINT) AS e FROM e4),
fixed AS (SELECT make_date(y::BIGINT, m::BIGINT, n::BIGINT) AS f FROM years, (VALUES (1,1),(5,1),(7,20),(8,7),(12,8),(12,25)) v(m,n)),
moved AS (SELECT make_date(y::BIGINT, m::BIGINT, n::BIGINT) AS f FROM years,
          (VALUES (1,6),(3,19),(6,29),(8,15),(10,12),(11,1),(11,11)) v(m,n)),
hol AS (SELECT f FROM fixed UNION SELECT CAST(f + CAST((8 - isodow(f)) % 7 AS INTEGER) AS DATE) FROM moved
        UNION SELECT CAST(e + n AS DATE) FROM easter, (VALUES (-3),(-2),(43),(64),(71)) v(n)),
base AS (SELECT d, d IN (SELECT f FROM hol) AS festivo, isodow(d) < 7 AND d NOT IN (SELECT f FROM hol) AS habil FROM days),
calendario AS (
SELECT d AS fecha_sk, d AS fecha_completa, CAST(year(d) AS INTEGER) AS anio, CAST(month(d) AS INTEGER) AS mes_del_anio,
       {MONTHS_SQL}[month(d)] AS nombre_mes, CAST(quarter(d) AS INTEGER) AS trimestre_del_anio,
       CAST((month(d) - 1) // 2 + 1 AS INTEGER) AS bimestre_del_anio, CAST(weekofyear(d) AS INTEGER) AS semana_del_anio,
       CAST(day(d) AS INTEGER) AS dia_del_mes, {DAYS_SQL}[isodow(d)] AS nombre_dia, isodow(d) = 7 AS es_fin_de_semana,
       habil AS es_dia_habil, festivo AS es_festivo,
       CASE WHEN habil THEN CAST(SUM(CAST(habil AS INTEGER)) OVER (PARTITION BY date_trunc('month', d) ORDER BY d) AS INTEGER) END
         AS dia_habil_del_mes,
       CAST(SUM(CAST(habil AS INTEGER)) OVER (PARTITION BY date_trunc('month', d)) AS INTEGER) AS total_dias_habiles_mes
FROM base)"""


def order_days(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("fecha"))


def order_calendar(spark, folder):
    return calendar.business_calendar(calendar.spine_over(order_days(spark, folder), "fecha"))


@query("calendar_business_days", f"""
WITH {CALENDAR}, n AS (SELECT CAST(o_orderdate AS DATE) AS f, COUNT(*) AS pedidos FROM orders GROUP BY 1)
SELECT calendario.*, COALESCE(pedidos, 0) AS pedidos FROM calendario LEFT JOIN n ON f = fecha_sk""")
def calendar_business_days(spark, folder):
    """The calendar of all years with orders, and the orders of each day."""
    per_day = order_days(spark, folder).groupBy("fecha").agg(F.count("*").alias("pedidos"))
    return order_calendar(spark, folder).join(
        per_day, F.col("fecha_sk") == F.col("fecha"), "left"
    ).drop("fecha").withColumn("pedidos", F.coalesce("pedidos", F.lit(0)))


# --- comparisons ---------------------------------------------------------------------

@query("reconcile_clients", """
WITH s AS (SELECT * FROM customer WHERE c_acctbal >= 0), a AS (
  SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 3000 THEN c_name || ' SAS'
         ELSE ' ' || lower(c_name) END AS nombre, CASE WHEN c_nationkey = 3 THEN 'OTRO' END AS direccion
  FROM customer WHERE c_nationkey <> 7)
SELECT CASE WHEN s.c_custkey IS NULL THEN 'NUEVO' WHEN a.c_custkey IS NULL THEN 'RETIRADO' ELSE 'MODIFICADO' END AS estado,
       COALESCE(s.c_custkey, a.c_custkey) AS cod_cliente_erp, COALESCE(s.c_mktsegment, a.c_mktsegment) AS empresa_erp,
       CASE WHEN s.c_custkey IS NOT NULL THEN upper(s.c_name) END AS nombre_anterior,
       CASE WHEN a.c_custkey IS NOT NULL THEN upper(trim(a.nombre)) END AS nombre_nuevo,
       CASE WHEN s.c_custkey IS NULL OR a.c_custkey IS NULL THEN '' ELSE
         concat_ws(',', CASE WHEN upper(s.c_name) <> upper(trim(a.nombre)) THEN 'nombre_erp' END,
                        CASE WHEN a.direccion IS NOT NULL THEN 'direccion_erp' END) END AS cambios
FROM s FULL JOIN a ON s.c_custkey = a.c_custkey AND s.c_mktsegment = a.c_mktsegment
WHERE s.c_custkey IS NULL OR a.c_custkey IS NULL OR upper(s.c_name) <> upper(trim(a.nombre)) OR a.direccion IS NOT NULL""")
def reconcile_clients(spark, folder):
    customers = table(spark, folder, "customer")
    key = [F.col("c_custkey").alias("cod_cliente_erp"), F.col("c_mktsegment").alias("empresa_erp")]
    stored = customers.filter(F.col("c_acctbal") >= 0).select(
        *key, F.col("c_name").alias("nombre_erp"), F.lit("").alias("direccion_erp")
    )
    renamed = (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") > 3000)
    feed = customers.filter(F.col("c_nationkey") != 7).select(
        *key,
        F.when(renamed, F.concat("c_name", F.lit(" SAS")))
        .otherwise(F.concat(F.lit(" "), F.lower("c_name"))).alias("nombre_erp"),
        F.when(F.col("c_nationkey") == 3, "OTRO").alias("direccion_erp"),
    )
    return reconcile.change_report(
        stored, feed, ["cod_cliente_erp", "empresa_erp"], ["nombre_erp", "direccion_erp"],
        "nombre_erp", removed=True,
    )


@query("reconcile_products", """
SELECT CASE WHEN p_size > 45 THEN 'NUEVO' ELSE 'MODIFICADO' END AS estado, p_partkey AS codigo_erp,
       CASE WHEN p_size <= 45 THEN upper(p_name) END AS nombre_anterior, upper(p_name) AS nombre_nuevo,
       CASE WHEN p_size <= 45 THEN 'linea' ELSE '' END AS cambios
FROM part WHERE p_size > 45 OR p_type = 'PROMO'""")
def reconcile_products(spark, folder):
    feed = table(spark, folder, "part").select(
        F.col("p_partkey").alias("codigo_erp"), F.col("p_name").alias("nombre"), F.col("p_type").alias("linea"), "p_size"
    )
    stored = feed.filter(F.col("p_size") <= 45).withColumn(
        "linea", F.when(F.col("linea") == "PROMO", "LANZAMIENTO").otherwise(F.col("linea"))
    )
    return reconcile.change_report(stored, feed, ["codigo_erp"], ["nombre", "linea"], "nombre")


@query("reconcile_sellers", f"""
WITH {ROLES},
g AS (SELECT cod_rol_erp, empresa_erp, 'D' || cod_rol_erp AS doc FROM roles WHERE fecha_fin_validez >= DATE '{AS_OF}'),
a AS (SELECT s_suppkey AS cod_rol_erp, empresa_erp,
             CASE WHEN s_nationkey < 5 THEN NULL WHEN s_nationkey < 10 THEN 'X' || s_suppkey ELSE ' D' || s_suppkey END AS doc
      FROM supplier, (VALUES ('F'), ('O'), ('P')) e(empresa_erp) WHERE s_nationkey < 22)
SELECT CASE WHEN g.cod_rol_erp IS NULL THEN 'NUEVO EN API' WHEN a.cod_rol_erp IS NULL THEN 'FALTA EN API (INACTIVO?)'
            ELSE 'INCONSISTENCIA DE DOCUMENTO' END AS estado,
       COALESCE(g.cod_rol_erp, a.cod_rol_erp) AS cod_rol_erp, COALESCE(g.empresa_erp, a.empresa_erp) AS empresa_erp,
       CASE WHEN a.cod_rol_erp IS NULL THEN 'No encontrado' ELSE a.doc END AS documento_en_api,
       CASE WHEN g.cod_rol_erp IS NULL THEN 'No existe' ELSE g.doc END AS documento_gestionado
FROM g FULL JOIN a ON g.cod_rol_erp = a.cod_rol_erp AND g.empresa_erp = a.empresa_erp
WHERE g.cod_rol_erp IS NULL OR a.cod_rol_erp IS NULL OR trim(a.doc) IS DISTINCT FROM trim(g.doc)""")
def reconcile_sellers(spark, folder):
    key = ["cod_rol_erp", "empresa_erp"]
    suppliers = table(spark, folder, "supplier")
    persons = suppliers.select(
        F.col("s_suppkey").alias("id_persona"),
        F.concat(F.lit("D"), F.col("s_suppkey").cast("string")).alias("documento"),
    )
    current = scd2.current_rows(roles(spark, folder), as_of(), "fecha_fin_validez")
    managed = current.join(persons, F.col("cod_rol_erp") == F.col("id_persona")).select(*key, "documento")
    code = F.col("s_suppkey").cast("string")
    feed = suppliers.filter(F.col("s_nationkey") < 22).select(
        F.col("s_suppkey").alias("cod_rol_erp"),
        F.explode(F.array(*map(F.lit, "FOP"))).alias("empresa_erp"),
        F.when(F.col("s_nationkey") < 5, F.lit(None)).when(F.col("s_nationkey") < 10, F.concat(F.lit("X"), code))
        .otherwise(F.concat(F.lit(" D"), code)).alias("documento"),
    )
    return reconcile.seller_report(managed, feed, key, "documento")


EXTRACT_DIFF = """
SELECT p_partkey AS codigo_erp, COALESCE(CASE WHEN p_size > 10 THEN p_brand END, '') AS referencia, p_name AS descripcion
FROM part WHERE p_type = 'MEDIUM'"""


def _extracts(spark, folder):
    second = table(spark, folder, "part").select(
        F.col("p_partkey").alias("codigo_erp"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("referencia"),
        F.col("p_name").alias("descripcion"), "p_type",
    )
    first = second.filter(F.col("p_type") != "MEDIUM")
    return first.drop("p_type"), second.drop("p_type")


@query("extract_diff_new", EXTRACT_DIFF)
def extract_diff_new(spark, folder):
    return reconcile.new_in_second(*_extracts(spark, folder), ["codigo_erp", "referencia"])


@query("extract_diff_top", EXTRACT_DIFF + " ORDER BY 1, 2 LIMIT 20")
def extract_diff_top(spark, folder):
    extract_keys = ["codigo_erp", "referencia"]
    return reconcile.first_rows(
        reconcile.new_in_second(*_extracts(spark, folder), extract_keys), extract_keys
    )


# --- audits --------------------------------------------------------------------------

@query("audit_products_pending", f"""
WITH {SALES}, {PRODUCTS},
act AS (SELECT codigo_producto_erp + 1 AS id FROM sales WHERE fecha_sk >= DATE '{AS_OF}' - INTERVAL 12 MONTH
        UNION SELECT l_partkey + 1 FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '{AS_OF}' - INTERVAL 3 MONTH),
done AS (SELECT codigo_erp, referencia FROM products WHERE cod_linea_erp IN ('PROMO', 'SMALL'))
SELECT DISTINCT codigo_erp, referencia, '' AS categoria_gestion, '' AS subcategoria_1_gestion,
       '' AS subcategoria_2_gestion, descripcion_erp AS descripcion_guia, '' AS clasificacion_py,
       '' AS equivalencia_py, '' AS peso_neto
FROM products p WHERE id_producto IN (SELECT id FROM act)
  AND NOT EXISTS (SELECT 1 FROM done d WHERE d.codigo_erp = p.codigo_erp AND d.referencia = p.referencia)""")
def audit_products_pending(spark, folder):
    catalog = products(spark, folder)
    sold = sales(spark, folder).select((F.col("codigo_producto_erp") + 1).alias("id_producto_fk"), "fecha_sk")
    stock = table(spark, folder, "lineitem").select(
        (F.col("l_partkey") + 1).alias("id_producto_fk"),
        F.col("l_shipdate").cast("date").alias("fecha_ultima_actualizacion"),
    )
    managed = catalog.filter(F.col("cod_linea_erp").isin("PROMO", "SMALL")).select(
        F.col("id_producto").alias("id_producto_fk")
    )
    return audit.pending_products(catalog, sold, stock, managed, as_of())


@query("audit_clients_pending", f"""
WITH {CLIENTS}
SELECT DISTINCT cod_cliente_erp AS cod_cliente_maestro, nit, nombre_erp AS nombre_unificado, '' AS canal, '' AS subcanal,
       cod_cliente_erp AS cod_cliente_erp_origen, empresa_erp AS empresa_erp_origen
FROM clients WHERE id_maestro_cliente_fk IS NULL AND EXISTS (
  SELECT 1 FROM orders WHERE o_custkey + 1 = id_cliente_empresa
  AND CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - INTERVAL 24 MONTH)""")
def audit_clients_pending(spark, folder):
    bought = table(spark, folder, "orders").select(
        (F.col("o_custkey") + 1).alias("id_cliente_empresa_fk"), F.col("o_orderdate").cast("date").alias("fecha_sk")
    )
    return audit.pending_clients(clients(spark, folder), bought, as_of())


# --- checks --------------------------------------------------------------------------

@query("gate_unmatched_products", f"""
WITH {PRODUCTS}
SELECT p_partkey AS codigo_erp, p_name AS descripcion FROM part
WHERE p_partkey NOT IN (SELECT codigo_erp FROM products)""")
def gate_unmatched_products(spark, folder):
    managed = table(spark, folder, "part").select(
        F.col("p_partkey").alias("codigo_erp"), F.col("p_name").alias("descripcion")
    )
    return quality.unmatched(managed, products(spark, folder), {"codigo_erp": "codigo_erp"})


@query("validated_reload", """
SELECT c_custkey AS cod, CASE WHEN c_acctbal >= 0 THEN c_custkey + 1 END AS id_maestro_cliente_fk, c_mktsegment AS canal,
       CASE WHEN c_acctbal >= 0 THEN 'CARGADO' ELSE 'SIN MAESTRO' END AS estado
FROM customer""")
def validated_reload(spark, folder):
    """The whole classification meets the gate, which stops it and reports the rows without a
    master client; without those rows the gate lets it pass."""
    master = clients(spark, folder)
    classification = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cod"), F.col("c_mktsegment").alias("canal")
    )
    on = {"cod": "cod_cliente_erp"}
    lost = quality.unmatched(classification, master, on)
    try:
        quality.gate(lost, "classification")
    except quality.GateError:
        classification = classification.join(lost.select("cod"), "cod", "left_anti")
        quality.gate(quality.unmatched(classification, master, on), "classification")
    else:
        lost = lost.limit(0)
    loaded = lookup(classification, master, on, {"id_cliente_empresa": "id_maestro_cliente_fk"})
    columns = ["cod", "id_maestro_cliente_fk", "canal", "estado"]
    return loaded.withColumn("estado", F.lit("CARGADO")).select(columns).unionByName(lost.withColumns({
        "id_maestro_cliente_fk": F.lit(None).cast("bigint"), "estado": F.lit("SIN MAESTRO")}).select(columns))


@query("dq_unique", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS filas FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1""")
def dq_unique(spark, folder):
    return quality.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_foreign_key", f"""
WITH {PRODUCTS}, {CLIENTS},
o AS (SELECT 'hechos_ventas.id_producto_fk' AS fk, l_partkey AS v, l_partkey IN (SELECT codigo_erp FROM products) AS ok FROM lineitem
      UNION ALL SELECT 'hechos_ventas.id_cliente_empresa_fk', o_custkey, o_custkey IN (SELECT cod_cliente_erp FROM clients) FROM orders
      UNION ALL SELECT 'dim_clientes_empresa.id_maestro_cliente_fk', id_maestro_cliente_fk,
             id_maestro_cliente_fk IN (SELECT c_custkey + 1000 FROM customer WHERE c_nationkey < 20) FROM clients)
SELECT fk, COUNT(*) FILTER (NOT ok AND v IS NOT NULL) AS filas_huerfanas,
       COUNT(DISTINCT CASE WHEN NOT ok THEN v END) AS valores_huerfanos, COUNT(*) FILTER (v IS NULL) AS filas_nulas
FROM o GROUP BY 1""")
def dq_foreign_key(spark, folder):
    catalog, registered = products(spark, folder), clients(spark, folder)
    master = table(spark, folder, "customer").filter(F.col("c_nationkey") < 20).select(
        (F.col("c_custkey") + 1000).alias("id")
    )
    return quality.orphan_counts([
        quality.ForeignKey("hechos_ventas.id_producto_fk", table(spark, folder, "lineitem"), "l_partkey", catalog, "codigo_erp"),
        quality.ForeignKey("hechos_ventas.id_cliente_empresa_fk", table(spark, folder, "orders"), "o_custkey", registered, "cod_cliente_erp"),
        quality.ForeignKey("dim_clientes_empresa.id_maestro_cliente_fk", registered, "id_maestro_cliente_fk", master, "id"),
    ])


@query("dq_column_profile", """
SELECT UNNEST(['codigo', 'c_name', 'c_acctbal']) AS columna, COUNT(*) AS filas,
       UNNEST([COUNT(*) FILTER (c_mktsegment = 'BUILDING'), COUNT(*) FILTER (c_name IS NULL), COUNT(*) FILTER (c_acctbal IS NULL)]) AS nulos,
       UNNEST([MAX(CASE WHEN c_mktsegment <> 'BUILDING' THEN length(CAST(c_custkey AS VARCHAR)) END), MAX(length(c_name)), MAX(length(CAST(CAST(c_acctbal AS DECIMAL(18,4)) AS VARCHAR)))]) AS largo_maximo,
       UNNEST([0, COUNT(*) FILTER (length(c_name) > 17), 0]) AS largos,
       UNNEST([0, 0, COUNT(*) FILTER (abs(c_acctbal) >= 1000)]) AS fuera_de_rango,
       UNNEST([COUNT(*) FILTER (c_mktsegment = 'BUILDING'), COUNT(*) FILTER (length(c_name) > 17),
               COUNT(*) FILTER (abs(c_acctbal) >= 1000)]) AS violaciones
FROM customer""")
def dq_column_profile(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).alias("codigo"), "c_name",
        money("c_acctbal", 18, 4).alias("c_acctbal"),
    )
    return quality.column_profile(customers, [
        quality.ColumnRule("codigo", required=True),
        quality.ColumnRule("c_name", required=True, max_length=17),
        quality.ColumnRule("c_acctbal", precision=7, scale=4),
    ])
