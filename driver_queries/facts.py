"""History and the sales fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.frames import (
    AS_OF, ENRICHED, ROLES, SALES, as_of, day, doubles, enriched_sales, money, query, role_lookup,
    roles, sales, table,
)
from tradewell.operators import enrich, merge, quality, scd2

ROLE_KEYS = ["cod_rol_erp", "empresa_erp"]
VALIDITY = ("fecha_inicio_validez", "fecha_fin_validez")


@query("scd2_point_in_time", f"""
WITH {SALES}, {ROLES}
SELECT CAST(EXTRACT(year FROM fecha_sk) AS INTEGER) AS anio, COUNT(*) AS lineas,
       COUNT(DISTINCT id_rol_historia) AS roles
FROM sales s JOIN roles r ON r.cod_rol_erp = s.cod_vendedor_erp AND r.empresa_erp = s.empresa_erp
  AND s.fecha_sk BETWEEN r.fecha_inicio_validez AND r.fecha_fin_validez
GROUP BY 1""")
def scd2_point_in_time(spark, folder):
    role = role_lookup(spark, folder)
    dated = scd2.point_in_time(
        sales(spark, folder).select("cod_vendedor_erp", "empresa_erp", "fecha_sk"), role.table, role.on, "fecha_sk", *VALIDITY,
        {"id_rol_historia": "id_rol_historia_fk"}, role.window, role.by_year,
    )
    return dated.filter(F.col("id_rol_historia_fk").isNotNull()).groupBy(
        F.year("fecha_sk").alias("anio")
    ).agg(F.count("*").alias("lineas"), F.countDistinct("id_rol_historia_fk").alias("roles"))


@query("scd2_current", f"""
WITH {ROLES} SELECT * FROM roles WHERE fecha_fin_validez >= DATE '{AS_OF}'""")
def scd2_current(spark, folder):
    return scd2.current_rows(roles(spark, folder), as_of(), "fecha_fin_validez")


OVERLAPPING = f"""{ROLES},
h AS (
  SELECT cod_rol_erp, empresa_erp, fecha_inicio_validez AS ini, fecha_fin_validez AS fin FROM roles
  UNION ALL
  SELECT s_suppkey, empresa_erp, CAST(cut - 10 AS DATE), CAST(cut + 5 AS DATE) FROM sellers WHERE s_acctbal > 5000
  UNION ALL
  SELECT s_suppkey, empresa_erp, cut, CAST(cut + 3 AS DATE) FROM sellers WHERE s_acctbal < 500
  UNION ALL
  SELECT s_suppkey, empresa_erp, DATE '2001-03-01', DATE '9999-12-31' FROM sellers WHERE s_acctbal > 9000)"""


@query("scd2_overlap", f"""
WITH {OVERLAPPING},
d AS (SELECT cod_rol_erp, empresa_erp, ini, COUNT(*) AS versiones, MAX(fin) AS last_fin, MIN(fin) AS first_fin
      FROM h GROUP BY ALL),
p AS (SELECT d.*, (SELECT MAX(fin) FROM h WHERE h.cod_rol_erp = d.cod_rol_erp AND h.empresa_erp = d.empresa_erp
                   AND h.ini < d.ini) AS fin_anterior FROM d),
c AS (SELECT *, GREATEST(CASE WHEN fin_anterior IS NOT NULL THEN CAST(LEAST(fin_anterior, last_fin) - ini AS INTEGER) + 1 ELSE -1 END,
        CASE WHEN versiones > 1 THEN CAST(first_fin - ini AS INTEGER) + 1 ELSE -1 END) AS covered,
        CAST(ini - fin_anterior AS INTEGER) - 1 AS gap FROM p)
SELECT cod_rol_erp, empresa_erp, ini AS fecha_inicio_validez, versiones, fin_anterior,
       CASE WHEN covered > 0 THEN 'SOLAPE' ELSE 'HUECO' END AS estado,
       CASE WHEN covered > 0 THEN covered ELSE gap END AS dias
FROM c WHERE covered > 0 OR gap > 0""")
def scd2_overlap(spark, folder):
    return scd2.overlap_report(overlapping_roles(spark, folder), ROLE_KEYS, *VALIDITY)


@query("scd2_close_overlaps", f"""
WITH {OVERLAPPING},
u AS (SELECT cod_rol_erp, empresa_erp, ini, MAX(fin) AS fin FROM h GROUP BY ALL),
n AS (SELECT *, CAST(LEAD(ini) OVER (PARTITION BY cod_rol_erp, empresa_erp ORDER BY ini) - 1 AS DATE) AS tope FROM u)
SELECT cod_rol_erp, empresa_erp, ini AS fecha_inicio_validez,
       CASE WHEN tope < fin THEN tope ELSE fin END AS fecha_fin_validez FROM n""")
def scd2_close_overlaps(spark, folder):
    return scd2.close_overlaps(overlapping_roles(spark, folder), ROLE_KEYS, *VALIDITY)


def overlapping_roles(spark, folder):
    """Roles, and versions made to overlap them or to leave a gap."""
    history = roles(spark, folder).select(*ROLE_KEYS, *VALIDITY)
    start, end = VALIDITY
    second = history.filter(F.col(start) > day("1900-01-01")).join(
        table(spark, folder, "supplier").select(F.col("s_suppkey").alias("cod_rol_erp"), "s_acctbal"),
        "cod_rol_erp",
    )
    cut = F.col(start)
    extra = F.array_compact(F.array(
        F.when(F.col("s_acctbal") > 5000, F.struct(F.date_sub(cut, 10).alias("i"), F.date_add(cut, 5).alias("f"))),
        F.when(F.col("s_acctbal") < 500, F.struct(cut.alias("i"), F.date_add(cut, 3).alias("f"))),
        F.when(F.col("s_acctbal") > 9000,
               F.struct(day("2001-03-01").alias("i"), day("9999-12-31").alias("f"))),
    ))
    made = second.select(*ROLE_KEYS, F.inline(extra)).toDF(*ROLE_KEYS, start, end)
    return history.unionByName(made)


@query("scd2_apply_changes", f"""
WITH history AS (
  SELECT c_custkey AS cliente, c_mktsegment AS canal, DATE '1995-01-01' AS ini, DATE '9999-12-31' AS fin
  FROM customer WHERE c_acctbal >= 0
  UNION ALL
  SELECT c_custkey, 'PROSPECTO', DATE '1990-01-01', DATE '1994-12-31' FROM customer WHERE c_mktsegment = 'BUILDING'),
incoming AS (
  SELECT c_custkey AS cliente, CASE WHEN c_acctbal > 8000 THEN 'PREFERENTE' ELSE c_mktsegment END AS canal
  FROM customer WHERE c_nationkey < 20),
op AS (SELECT * FROM history WHERE fin = DATE '9999-12-31')
SELECT * FROM history WHERE fin <> DATE '9999-12-31'
UNION ALL
SELECT o.cliente, o.canal, o.ini,
       CASE WHEN i.cliente IS NOT NULL AND i.canal <> o.canal THEN CAST(DATE '{AS_OF}' - 1 AS DATE) ELSE o.fin END
FROM op o LEFT JOIN incoming i ON i.cliente = o.cliente
UNION ALL
SELECT i.cliente, i.canal, DATE '{AS_OF}', DATE '9999-12-31'
FROM incoming i LEFT JOIN op o ON i.cliente = o.cliente WHERE o.cliente IS NULL OR o.canal <> i.canal""")
def scd2_apply_changes(spark, folder):
    customers = table(spark, folder, "customer")
    client = F.col("c_custkey").alias("cliente")
    opened = customers.filter(F.col("c_acctbal") >= 0).select(
        client, F.col("c_mktsegment").alias("canal"), day("1995-01-01").alias("ini"),
        scd2.open_end().alias("fin"),
    )
    ended = customers.filter(F.col("c_mktsegment") == "BUILDING").select(
        client, F.lit("PROSPECTO").alias("canal"), day("1990-01-01").alias("ini"),
        day("1994-12-31").alias("fin"),
    )
    incoming = customers.filter(F.col("c_nationkey") < 20).select(
        client,
        F.when(F.col("c_acctbal") > 8000, "PREFERENTE").otherwise(F.col("c_mktsegment")).alias("canal"),
    )
    return scd2.apply_changes(
        opened.unionByName(ended), incoming, ["cliente"], ["canal"], "ini", "fin", as_of()
    )


FACT_COLUMNS = [
    "numero_factura_erp", "fecha_sk", "fecha_envio", "codigo_producto_erp", "cod_vendedor_erp",
    "id_producto_fk", "id_cliente_empresa_fk", "id_rol_historia_fk", "id_bodega_fk", "cantidad",
    "valor_base",
]


@query("fact_sales_enrich", f"""
WITH {ENRICHED}
SELECT numero_factura_erp, fecha_sk, fecha_envio, codigo_producto_erp, cod_vendedor_erp, id_producto_fk,
       id_cliente_empresa_fk, id_rol_historia_fk, id_bodega_fk, CAST(cantidad AS DOUBLE) AS cantidad,
       CAST(valor_base AS DOUBLE) AS valor_base, CAST(0 AS DOUBLE) AS valor_descuento
FROM enriched WHERE motivo_rechazo IS NULL""")
def fact_sales_enrich(spark, folder):
    fact = enrich.valid(enriched_sales(spark, folder))
    kept = fact.select(*enrich.present(fact, FACT_COLUMNS)).withColumn(
        "valor_descuento", F.coalesce(F.lit(None).cast("double"), F.lit(0.0))
    )
    return doubles(kept, "cantidad", "valor_base")


@query("fact_sales_rejects", f"""
WITH {ENRICHED}
SELECT motivo_rechazo, COUNT(*) AS lineas, CAST(SUM(valor_base) AS DOUBLE) AS valor_base
FROM enriched WHERE motivo_rechazo IS NOT NULL GROUP BY 1""")
def fact_sales_rejects(spark, folder):
    by_reason = enrich.rejects(enriched_sales(spark, folder)).groupBy("motivo_rechazo").agg(
        F.count("*").alias("lineas"), F.sum("valor_base").alias("valor_base")
    )
    return doubles(by_reason, "valor_base")


@query("load_metrics", f"""
WITH {ENRICHED}
SELECT COUNT(*) AS leidas, COUNT(*) FILTER (motivo_rechazo IS NULL) AS validas,
       COUNT(*) FILTER (motivo_rechazo IS NOT NULL) AS rechazadas FROM enriched""")
def load_metrics(spark, folder):
    """Counted while the load writes its rows; no second pass over them."""
    frame, counts = quality.observed(enriched_sales(spark, folder), enrich.REASON)
    frame.write.format("noop").mode("overwrite").save()
    return quality.observed_metrics(spark, counts)


@query("fact_range_reload", """
WITH target AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS fecha_sk, CAST(o_totalprice AS DECIMAL(12,2)) AS valor FROM orders),
fresh AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS fecha_sk,
         CAST(CAST(o_totalprice AS DECIMAL(12,2)) + 10 AS DECIMAL(12,2)) AS valor
  FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'
    AND isodow(o_orderdate) <= 5)
SELECT o_orderkey, fecha_sk, CAST(valor AS DOUBLE) AS valor FROM target
WHERE fecha_sk NOT BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'
UNION ALL SELECT o_orderkey, fecha_sk, CAST(valor AS DOUBLE) FROM fresh""")
def fact_range_reload(spark, folder):
    target = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("fecha_sk"),
        money("o_totalprice").alias("valor"),
    )
    low, high = day("1998-03-01"), day("1998-03-31")
    # The weekends of the month have no new rows and must vanish.
    new = target.filter(F.col("fecha_sk").between(low, high) & (F.weekday("fecha_sk") < 5)).withColumn(
        "valor", (F.col("valor") + 10).cast("decimal(12,2)")
    )
    return doubles(merge.reload_range(target, new, "fecha_sk", low, high), "valor")
