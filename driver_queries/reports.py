"""Star reports and the commission model."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.feeds import CALENDAR, order_calendar
from driver_queries.frames import (
    CLIENTS, ENRICHED, PRODUCTS, ROLES, SALES, SHIPPED, clients, day, doubles, enriched_sales,
    money, products, query, role_lookup, sales, shipped, table,
)
from tradewell.operators import hierarchy, scd2
from tradewell.operators.enrich import valid
from tradewell.operators.lookup import lookup
from tradewell.plans import commissions, marts
from tradewell.plans.marts import Star
from tradewell.session import ensure_checkpoint_dir

def base():
    return F.col("valor_base")


def geography(spark, folder):
    """Client with the names of nation and region."""
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", F.col("r_name").alias("region"), F.col("n_name").alias("nacion"))
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey"), nations


@query("mart_sales_rollup", f"""
WITH {SALES}
SELECT r_name AS region, n_name AS nacion, CAST(year(fecha_sk) AS INTEGER) AS anio,
       CAST(SUM(valor_base) AS DOUBLE) AS valor_base, CAST(SUM(cantidad) AS DOUBLE) AS cantidad, COUNT(*) AS lineas,
       CAST(GROUPING(r_name) + GROUPING(n_name) + GROUPING(year(fecha_sk)) AS INTEGER) AS nivel
FROM sales JOIN customer ON c_custkey = cod_cliente_erp JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey
GROUP BY ROLLUP (r_name, n_name, year(fecha_sk))""")
def mart_sales_rollup(spark, folder):
    customers, nations = geography(spark, folder)
    rolled = marts.sales_rollup(
        sales(spark, folder), {"valor_base": base(), "cantidad": F.col("cantidad")},
        [Star(customers, "cod_cliente_erp", "c_custkey", {"c_nationkey": "id_nacion"}),
         Star(nations, "id_nacion", "n_nationkey", {"region": "region", "nacion": "nacion"})],
        ["region", "nacion", "anio"], {"anio": F.year("fecha_sk")},
    )
    return doubles(rolled, "valor_base", "cantidad")


@query("mart_margin", f"""
WITH {SALES},
m AS (SELECT p_brand AS marca, CAST(year(fecha_sk) AS INTEGER) AS anio, SUM(valor_base) AS base,
             SUM(CAST(p_retailprice AS DECIMAL(12,2)) * cantidad) AS costo, COUNT(*) AS lineas
      FROM sales JOIN part ON p_partkey = codigo_producto_erp GROUP BY ALL)
SELECT marca, anio, CAST(base AS DOUBLE) AS valor_base, CAST(costo AS DOUBLE) AS costo_total, lineas,
       CAST(base - costo AS DOUBLE) AS margen, CAST(base - costo AS DOUBLE) / CAST(base AS DOUBLE) AS margen_pct FROM m""")
def mart_margin(spark, folder):
    """Cost is the part's price times the quantity; lines are summed by part and year before they meet the parts."""
    part = Star(table(spark, folder, "part"), "codigo_producto_erp", "p_partkey", {"p_retailprice": "precio", "p_brand": "marca"})
    return doubles(marts.margin_by_price(
        sales(spark, folder), base(), F.col("cantidad"), part, money("precio"), ["marca", "anio"], {"anio": F.year("fecha_sk")},
    ), "valor_base", "costo_total", "margen")


@query("mart_returns", f"""
WITH {SALES}
SELECT estado_linea AS motivo_devolucion, CAST(year(fecha_sk) AS INTEGER) AS anio, COUNT(*) AS lineas,
       CAST(SUM(cantidad) AS DOUBLE) AS cantidad, CAST(SUM(valor_base) AS DOUBLE) AS valor
FROM sales WHERE marca_devolucion = 'R' GROUP BY ALL""")
def mart_returns(spark, folder):
    return doubles(marts.returns(
        sales(spark, folder), F.col("marca_devolucion") == "R", F.col("estado_linea"), base(),
        F.col("cantidad"), "fecha_sk",
    ), "cantidad", "valor")


@query("mart_inventory_trend", f"""
WITH {SHIPPED},
m AS (SELECT p_type AS linea, CAST(date_trunc('month', dia) AS DATE) AS fecha_snapshot, CAST(SUM(cantidad) AS DOUBLE) AS cantidad
      FROM shipped JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT *, LAG(cantidad) OVER w AS cantidad_anterior, cantidad - LAG(cantidad) OVER w AS variacion
FROM m WINDOW w AS (PARTITION BY linea ORDER BY fecha_snapshot)""")
def mart_inventory_trend(spark, folder):
    monthly = marts.sums_by(
        table(spark, folder, "lineitem"), {"q": money("l_quantity")},
        [Star(table(spark, folder, "part"), "l_partkey", "p_partkey", {"p_type": "linea"})],
        ["linea", "fecha_snapshot"], {"fecha_snapshot": F.trunc(F.col("l_shipdate").cast("date"), "month")},
    )
    return doubles(
        marts.stock_trend(monthly, ["linea"], "fecha_snapshot", "q"),
        "cantidad", "cantidad_anterior", "variacion",
    )


@query("mart_drill_across", f"""
WITH {SALES}, {SHIPPED},
v AS (SELECT bodega_erp AS bodega, SUM(valor_base) AS valor, SUM(cantidad) AS vendido FROM sales GROUP BY 1),
s AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS bodega, SUM(cantidad) AS existencia FROM shipped
      GROUP BY 1)
SELECT bodega, CAST(valor AS DOUBLE) AS valor, CAST(vendido AS DOUBLE) AS vendido, CAST(existencia AS DOUBLE) AS existencia
FROM v FULL JOIN s USING (bodega)""")
def mart_drill_across(spark, folder):
    sold = sales(spark, folder).withColumnRenamed("bodega_erp", "bodega")
    stock = shipped(spark, folder).withColumn(
        "bodega", F.lpad(F.col("s_nationkey").cast("string"), 2, "0")
    )
    return doubles(marts.drill_across(
        sold, stock, ["bodega"], {"valor": base(), "vendido": F.col("cantidad")},
        {"existencia": F.col("cantidad")},
    ), "valor", "vendido", "existencia")


@query("mart_pacing", f"""
WITH {SALES}, {CALENDAR},
d AS (SELECT empresa_erp, fecha_sk, SUM(valor_base) AS valor_dia FROM sales GROUP BY ALL),
k AS (SELECT fecha_sk AS f, CAST(SUM(CAST(es_dia_habil AS INTEGER)) OVER (PARTITION BY date_trunc('month', fecha_sk) ORDER BY fecha_sk) AS INTEGER)
        AS dias_habiles, total_dias_habiles_mes FROM calendario)
SELECT empresa_erp, fecha_sk, CAST(valor_dia AS DOUBLE) AS valor_dia, dias_habiles, total_dias_habiles_mes,
       CAST(SUM(valor_dia) OVER (PARTITION BY empresa_erp, date_trunc('month', fecha_sk) ORDER BY fecha_sk) AS DOUBLE) AS valor_acumulado,
       CAST(dias_habiles AS DOUBLE) / total_dias_habiles_mes AS avance_dias
FROM d JOIN k ON f = fecha_sk""")
def mart_pacing(spark, folder):
    return doubles(marts.pacing(
        sales(spark, folder), "fecha_sk", base(), order_calendar(spark, folder), ["empresa_erp"]
    ), "valor_dia", "valor_acumulado")


@query("mart_client_class_asof", f"""
WITH {SALES},
h AS (SELECT c_custkey AS cliente, CAST('1994-12-31' AS DATE) AS ini, CAST(DATE '1998-01-01' + c_nationkey AS DATE) AS fin, c_mktsegment AS canal
      FROM customer UNION ALL
      SELECT c_custkey, CAST(DATE '1998-01-02' + c_nationkey AS DATE), DATE '9999-12-31',
             CASE WHEN c_acctbal > 5000 THEN 'PREFERENTE' ELSE c_mktsegment END FROM customer WHERE c_acctbal >= 0)
SELECT canal, CAST(year(fecha_sk) AS INTEGER) AS anio, CAST(SUM(valor_base) AS DOUBLE) AS valor_base, COUNT(*) AS lineas
FROM sales LEFT JOIN h ON cliente = cod_cliente_erp AND fecha_sk BETWEEN ini AND fin GROUP BY ALL""")
def mart_client_class_asof(spark, folder):
    """Sales by the class the client had on the day of the sale; null where it had none."""
    cut = F.date_add(day("1998-01-01"), F.col("c_nationkey"))
    versions = F.array_compact(F.array(
        F.struct(day("1994-12-31").alias("ini"), cut.alias("fin"), F.col("c_mktsegment").alias("canal")),
        F.when(F.col("c_acctbal") >= 0, F.struct(
            F.date_add(cut, 1).alias("ini"), scd2.open_end().alias("fin"),
            F.when(F.col("c_acctbal") > 5000, "PREFERENTE").otherwise(F.col("c_mktsegment")).alias("canal"),
        )),
    ))
    history = table(spark, folder, "customer").select(F.col("c_custkey").alias("cliente"), F.inline(versions))
    return doubles(marts.sums_as_of(
        sales(spark, folder), "cod_cliente_erp", "fecha_sk", {"valor_base": base()}, history,
        "cliente", "ini", "fin", {"canal": "canal"},
        {"canal": F.col("canal"), "anio": F.year("fecha_sk")},
    ), "valor_base")


CATEGORY = """
cat AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS id FROM (SELECT DISTINCT p_type FROM part)),
h AS (SELECT p_partkey, p_type AS tipo, DATE '1990-01-01' AS ini, CAST(DATE '1997-12-31' + p_size * 10 AS DATE) AS fin FROM part
      UNION ALL SELECT p_partkey, 'PROMO', CAST(DATE '1998-01-01' + p_size * 10 AS DATE), DATE '9999-12-31' FROM part)"""


@query("mart_category_asof", f"""
WITH {SALES}, {CATEGORY}
SELECT tipo AS nombre_categoria_tq, CASE WHEN tipo IN ('PROMO', 'ECONOMY') THEN 'OFERTA' ELSE 'REGULAR' END AS nombre_negocio_tq,
       CAST(SUM(valor_base) AS DOUBLE) AS valor_base, COUNT(*) AS lineas
FROM sales JOIN h ON p_partkey = codigo_producto_erp AND fecha_sk BETWEEN ini AND fin GROUP BY ALL""")
def mart_category_asof(spark, folder):
    part = table(spark, folder, "part")
    cut = F.date_add(day("1998-01-01"), F.col("p_size") * 10)
    history = part.select(
        F.col("p_partkey").alias("id_producto_fk"),
        F.inline(F.array(
            F.struct(F.col("p_type").alias("id_categoria_tq_fk"), day("1990-01-01").alias("fecha_inicio_validez"),
                     F.date_sub(cut, 1).alias("fecha_fin_validez")),
            F.struct(F.lit("PROMO").alias("id_categoria_tq_fk"), cut.alias("fecha_inicio_validez"),
                     scd2.open_end().alias("fecha_fin_validez")),
        )),
    )
    categories = part.select("p_type").distinct().select(
        F.col("p_type").alias("id_categoria_tq"), F.col("p_type").alias("nombre_categoria_tq"),
        F.when(F.col("p_type").isin("PROMO", "ECONOMY"), 1).otherwise(2).alias("id_negocio_tq_fk"),
    )
    businesses = categories.select("id_negocio_tq_fk").distinct().select(
        F.col("id_negocio_tq_fk").alias("id_negocio_tq"),
        F.when(F.col("id_negocio_tq_fk") == 1, "OFERTA").otherwise("REGULAR").alias("nombre_negocio_tq"),
    )
    return doubles(marts.category_as_of(
        sales(spark, folder), "codigo_producto_erp", "fecha_sk", {"valor_base": base()}, history,
        categories, businesses,
    ), "valor_base")


@query("mart_product_state_asof", f"""
WITH {SALES},
h AS (SELECT p_partkey, 'Activo' AS estado, DATE '1990-01-01' AS ini,
             CASE WHEN p_size > 30 THEN CAST(DATE '1999-06-30' + p_size AS DATE) ELSE DATE '9999-12-31' END AS fin FROM part
      UNION ALL SELECT p_partkey, 'Descontinuado', CAST(DATE '1999-07-01' + p_size AS DATE), DATE '9999-12-31' FROM part WHERE p_size > 30)
SELECT estado, CAST(year(fecha_sk) AS INTEGER) AS anio, CAST(SUM(cantidad) AS DOUBLE) AS cantidad, COUNT(*) AS lineas
FROM sales JOIN h ON p_partkey = codigo_producto_erp AND fecha_sk BETWEEN ini AND fin GROUP BY ALL""")
def mart_product_state_asof(spark, folder):
    """Units sold by the state the product had on the day of the sale."""
    retired = F.date_add(day("1999-07-01"), F.col("p_size"))
    ends = F.col("p_size") > 30
    versions = F.array_compact(F.array(
        F.struct(F.lit("Activo").alias("estado"), day("1990-01-01").alias("ini"),
                 F.when(ends, F.date_sub(retired, 1)).otherwise(scd2.open_end()).alias("fin")),
        F.when(ends, F.struct(F.lit("Descontinuado").alias("estado"), retired.alias("ini"),
                              scd2.open_end().alias("fin"))),
    ))
    history = table(spark, folder, "part").select(F.col("p_partkey").alias("producto"), F.inline(versions))
    return doubles(marts.sums_as_of(
        sales(spark, folder), "codigo_producto_erp", "fecha_sk", {"cantidad": F.col("cantidad")}, history,
        "producto", "ini", "fin", {"estado": "estado"},
        {"estado": F.col("estado"), "anio": F.year("fecha_sk")},
    ), "cantidad")


@query("mart_portfolio", f"""
WITH {SALES},
b AS (SELECT cod_vendedor_erp, p_brand, fecha_sk, valor_base FROM sales JOIN part ON p_partkey = codigo_producto_erp),
f AS (SELECT DISTINCT cod_vendedor_erp, p_brand FROM b WHERE fecha_sk < DATE '1995-04-01'),
x AS (SELECT b.*, f.p_brand IS NOT NULL AS dentro FROM b LEFT JOIN f USING (cod_vendedor_erp, p_brand))
SELECT cod_vendedor_erp, COALESCE(CAST(SUM(valor_base) FILTER (dentro) AS DOUBLE), 0) AS valor_dentro,
       COALESCE(CAST(SUM(valor_base) FILTER (NOT dentro) AS DOUBLE), 0) AS valor_fuera,
       COUNT(*) FILTER (dentro) AS lineas_dentro, COUNT(*) FILTER (NOT dentro) AS lineas_fuera FROM x GROUP BY 1""")
def mart_portfolio(spark, folder):
    """A seller's portfolio is what the seller sold in the first quarter."""
    fact, part = sales(spark, folder), table(spark, folder, "part")
    early = fact.filter(F.col("fecha_sk") < day("1995-04-01")).select("cod_vendedor_erp", "codigo_producto_erp").distinct()
    portfolio = lookup(early, part, {"codigo_producto_erp": "p_partkey"}, {"p_brand": "linea"}).select(
        F.col("cod_vendedor_erp").alias("vendedor"), "linea"
    ).distinct()
    return doubles(marts.portfolio_coverage(
        fact, "cod_vendedor_erp", "codigo_producto_erp", base(), part, "p_partkey", "p_brand",
        portfolio, "vendedor", "linea",
    ), "valor_dentro", "valor_fuera")


@query("mart_assortment", f"""
WITH {SALES},
a AS (SELECT p_type AS categoria, p_partkey FROM part WHERE p_size <= 5),
t AS (SELECT categoria, COUNT(*) AS n FROM a GROUP BY 1)
SELECT cod_cliente_erp, categoria, COUNT(DISTINCT p_partkey) AS productos_comprados, ANY_VALUE(n) AS productos_surtido,
       CAST(COUNT(DISTINCT p_partkey) AS DOUBLE) / ANY_VALUE(n) AS cobertura
FROM sales JOIN a ON p_partkey = codigo_producto_erp JOIN t USING (categoria) GROUP BY ALL""")
def mart_assortment(spark, folder):
    assortment = table(spark, folder, "part").filter(F.col("p_size") <= 5).select(
        F.col("p_type").alias("categoria"), F.col("p_partkey").alias("producto")
    )
    return marts.assortment_coverage(
        sales(spark, folder), "cod_cliente_erp", "codigo_producto_erp", assortment, "categoria", "producto"
    )


@query("mart_supervisor", """
WITH RECURSIVE own AS (SELECT l_suppkey AS vendedor, SUM(CAST(l_quantity AS DECIMAL(12,2))) AS q FROM lineitem GROUP BY 1),
up(vendedor, jefe, q) AS (SELECT vendedor, vendedor, q FROM own
  UNION ALL SELECT vendedor, jefe // 10, q FROM up WHERE jefe // 10 <> jefe)
SELECT jefe AS vendedor, CAST(SUM(q) FILTER (vendedor = jefe) AS DOUBLE) AS propio, CAST(SUM(q) AS DOUBLE) AS acumulado
FROM up GROUP BY 1""")
def mart_supervisor(spark, folder):
    """Each seller reports to the one with a tenth of the key; seller 0 to itself."""
    edges = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("vendedor"), F.expr("s_suppkey div 10").alias("jefe")
    )
    sold = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("vendedor"), money("l_quantity").alias("q")
    )
    return doubles(hierarchy.rollup_to_ancestors(edges, sold, "vendedor", "jefe", "q"), "propio", "acumulado")


# --- commissions -----------------------------------------------------------------------

ITEMS = """
items AS (SELECT DISTINCT 'S-' || p_type AS id_item_regla, p_type AS linea_aplicacion, 'SUMA_VALOR_BASE' AS tipo_calculo FROM part
          WHERE p_type <> 'PROMO'
          UNION ALL SELECT 'S-TOTAL', 'TOTAL', 'SUMA_VALOR_BASE'
          UNION ALL SELECT DISTINCT 'I-' || p_type, p_type, 'CONTEO_IMPACTOS_CLIENTE' FROM part WHERE p_type IN ('SMALL', 'LARGE')
          UNION ALL SELECT 'I-TOTAL', 'TOTAL', 'CONTEO_IMPACTOS_CLIENTE')"""
MONTHLY = f"""{ENRICHED}, {ITEMS},
m AS (SELECT *, CAST(date_trunc('month', fecha_sk) AS DATE) AS periodo FROM enriched WHERE motivo_rechazo IS NULL)"""


def items(spark, folder):
    kinds = table(spark, folder, "part").select("p_type").distinct()
    line = F.col("p_type").alias("linea_aplicacion")
    sums = kinds.filter(F.col("p_type") != "PROMO").select(
        F.concat(F.lit("S-"), "p_type").alias("id_item_regla"), line, F.lit(commissions.SUM_OF_BASE).alias("tipo_calculo"))
    impacts = kinds.filter(F.col("p_type").isin("SMALL", "LARGE")).select(
        F.concat(F.lit("I-"), "p_type").alias("id_item_regla"), line, F.lit(commissions.CLIENT_IMPACTS).alias("tipo_calculo"))
    totals = spark.createDataFrame(
        [("S-TOTAL", commissions.ALL_LINES, commissions.SUM_OF_BASE),
         ("I-TOTAL", commissions.ALL_LINES, commissions.CLIENT_IMPACTS)], sums.schema)
    return sums.unionByName(impacts).unionByName(totals)


def monthly_sales(spark, folder):
    return valid(enriched_sales(spark, folder)).withColumn("periodo", F.trunc("fecha_sk", "month"))


def achieved_base(spark, folder):
    return commissions.sum_of_base(
        monthly_sales(spark, folder), "id_rol_historia_fk", "periodo", "cod_linea_erp", "valor_base", items(spark, folder)
    )


@query("comm_sum_base", f"""
WITH {MONTHLY}
SELECT id_item_regla, id_rol_historia_fk, periodo, CAST(SUM(valor_base) AS DOUBLE) AS valor_logrado
FROM m JOIN items ON tipo_calculo = 'SUMA_VALOR_BASE' AND (linea_aplicacion = 'TOTAL' OR linea_aplicacion = cod_linea_erp) GROUP BY ALL""")
def comm_sum_base(spark, folder):
    return doubles(achieved_base(spark, folder), "valor_logrado")


@query("comm_impacts", f"""
WITH {MONTHLY}
SELECT id_item_regla, id_rol_historia_fk, periodo, COUNT(DISTINCT id_cliente_empresa_fk) AS valor_logrado
FROM m JOIN items ON tipo_calculo = 'CONTEO_IMPACTOS_CLIENTE' AND (linea_aplicacion = 'TOTAL' OR linea_aplicacion = cod_linea_erp)
GROUP BY ALL""")
def comm_impacts(spark, folder):
    return commissions.client_impacts(
        monthly_sales(spark, folder), "id_rol_historia_fk", "periodo", "cod_linea_erp",
        "id_cliente_empresa_fk", items(spark, folder),
    )


@query("comm_attainment", f"""
WITH {MONTHLY},
a AS (SELECT id_item_regla, id_rol_historia_fk, periodo, SUM(valor_base) AS v
      FROM m JOIN items ON tipo_calculo = 'SUMA_VALOR_BASE' AND (linea_aplicacion = 'TOTAL' OR linea_aplicacion = cod_linea_erp) GROUP BY ALL),
g AS (SELECT id_item_regla, id_rol_historia_fk, CAST(periodo + INTERVAL 1 MONTH AS DATE) AS periodo, CAST(v AS DOUBLE) AS meta FROM a),
j AS (SELECT g.*, COALESCE(CAST(a.v AS DOUBLE), 0) AS logrado, COALESCE(CAST(a.v AS DOUBLE), 0) / g.meta AS pct,
             CASE WHEN id_item_regla = 'S-TOTAL' THEN 0.4 ELSE 0.1 END AS peso, CASE WHEN id_item_regla = 'S-TOTAL' THEN 0.8 END AS minimo
      FROM g LEFT JOIN a USING (id_item_regla, id_rol_historia_fk, periodo))
SELECT id_item_regla, id_rol_historia_fk, periodo, logrado AS valor_logrado, meta AS valor_meta, pct AS porcentaje_cumplimiento,
       CAST(CASE WHEN pct < COALESCE(minimo, 0) THEN 0 ELSE LEAST(pct, CAST(1.2 AS DOUBLE)) END AS DOUBLE) * CAST(peso AS DOUBLE) AS porcentaje_liquidacion_final FROM j""")
def comm_attainment(spark, folder):
    """The goal of a month is what the role achieved in the month before."""
    ensure_checkpoint_dir(spark)
    # Used as achievement and as next month's goal: computed once.
    achieved = doubles(achieved_base(spark, folder), "valor_logrado").checkpoint()
    goals = achieved.select(
        "id_item_regla", "id_rol_historia_fk", F.add_months("periodo", 1).alias("periodo"),
        F.col("valor_logrado").alias("valor_meta"),
    )
    is_total = F.col("id_item_regla") == "S-TOTAL"
    rules = items(spark, folder).select(
        "id_item_regla", F.when(is_total, 0.4).otherwise(0.1).alias("peso_sobre_padre"),
        F.when(is_total, 0.8).alias("min_cumplimiento"), F.lit(1.2).alias("max_cumplimiento"),
    )
    return commissions.attainment(
        achieved, goals, rules, ["id_item_regla", "id_rol_historia_fk", "periodo"]
    )


# Half up in whole ten-thousandths, as DuckDB divides decimals as doubles.
def _average(weight: str, value: str) -> str:
    total = f"CAST(SUM({weight} * {value}) * 10000 AS HUGEINT)"
    return f"CAST(((2 * {total} + SUM({weight})) // (2 * SUM({weight}))) AS DECIMAL(18,0)) * CAST(0.0001 AS DECIMAL(5,4))"


@query("comm_rule_tree", f"""
WITH l AS (SELECT c_mktsegment AS rol, c_nationkey AS n, CAST(c_custkey % 3 + 1 AS INTEGER) AS w, CAST(c_acctbal AS DECIMAL(12,2)) AS v
           FROM customer WHERE c_acctbal >= 0),
n1 AS (SELECT rol, n, CAST({_average("w", "v")} AS DECIMAL(18,4)) AS v FROM l GROUP BY ALL),
-- the nations of region 4 hang on the top itself
r1 AS (SELECT rol, n_regionkey AS r, CAST({_average("(n_nationkey + 1)", "v")} AS DECIMAL(18,4)) AS v
       FROM n1 JOIN nation ON n_nationkey = n WHERE n_regionkey < 4 GROUP BY ALL),
c1 AS (SELECT rol, r + 1 AS w, v FROM r1 UNION ALL SELECT rol, n_nationkey + 1, v FROM n1 JOIN nation ON n_nationkey = n WHERE n_regionkey = 4),
t1 AS (SELECT rol, CAST({_average("w", "v")} AS DECIMAL(18,4)) AS v FROM c1 GROUP BY ALL)
SELECT rol, 'N' || n AS item, CASE WHEN n_regionkey < 4 THEN 2 ELSE 1 END::INTEGER AS nivel, CAST(v AS DOUBLE) AS valor FROM n1 JOIN nation ON n_nationkey = n
UNION ALL SELECT rol, 'R' || r, 1, CAST(v AS DOUBLE) FROM r1 UNION ALL SELECT rol, 'T', 0, CAST(v AS DOUBLE) FROM t1""")
def comm_rule_tree(spark, folder):
    """A tree of unequal depth for each segment; customers are the leaves, some without a value."""
    def name(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    top = F.col("n_regionkey") == 4
    regions = table(spark, folder, "region").filter("r_regionkey < 4").select(
        name("R", "r_regionkey").alias("item"), F.lit("T").alias("padre"), (F.col("r_regionkey") + 1).alias("peso"))
    nations = table(spark, folder, "nation").select(
        name("N", "n_nationkey").alias("item"), F.when(top, "T").otherwise(name("R", "n_regionkey")).alias("padre"),
        (F.col("n_nationkey") + 1).alias("peso"))
    tops = regions.select("padre").distinct().select(
        F.col("padre").alias("item"), F.lit(None).cast("string").alias("padre"), F.lit(1).alias("peso"))
    leaves = table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("rol"), name("N", "c_nationkey").alias("padre"), (F.col("c_custkey") % 3 + 1).cast("int").alias("peso"),
        F.when(F.col("c_acctbal") >= 0, money("c_acctbal")).alias("valor"),
    )
    tree = tops.unionByName(regions).unionByName(nations)
    return doubles(hierarchy.weighted_tree(tree, leaves, "item", "padre", "peso", "valor", ["rol"]), "valor")


@query("comm_rule_params", """
WITH p AS (SELECT s_suppkey, UNNEST([s_suppkey, s_suppkey + 7, s_suppkey + 7, s_suppkey + 31]) AS producto, s_nationkey + 5 AS minimo
           FROM supplier WHERE s_acctbal >= 0),
d AS (SELECT DISTINCT * FROM p),
q AS (SELECT l_suppkey, l_partkey, SUM(CAST(l_quantity AS DECIMAL(12,2))) AS cantidad FROM lineitem GROUP BY ALL)
SELECT 'R' || s_suppkey AS id_item_regla, COUNT(*) AS productos, COUNT(q.cantidad) AS vendidos,
       COUNT(*) FILTER (q.cantidad >= minimo) AS cumplidos
FROM d LEFT JOIN q ON l_suppkey = s_suppkey AND l_partkey = producto GROUP BY 1""")
def comm_rule_params(spark, folder):
    """Rules whose JSON lists products and a minimum; sellers in debt have a broken text."""
    key = F.col("s_suppkey")
    numbers = [key, key + 7, key + 7, key + 31]
    rules = table(spark, folder, "supplier").select(
        F.concat(F.lit("R"), key.cast("string")).alias("id_item_regla"),
        F.when(F.col("s_acctbal") >= 0, F.concat(
            F.lit('{"productos":["'), F.concat_ws('","', *[n.cast("string") for n in numbers]),
            F.lit('"],"minimo":'), (F.col("s_nationkey") + 5).cast("string"), F.lit("}"),
        )).otherwise("{productos").alias("parametros_json"),
    )
    wanted = commissions.rule_products(rules)
    sold = table(spark, folder, "lineitem").select(
        F.concat(F.lit("R"), F.col("l_suppkey").cast("string")).alias("regla"),
        F.col("l_partkey").cast("string").alias("producto"), money("l_quantity").alias("__q"),
    ).join(
        wanted.select(F.col("id_item_regla").alias("regla"), F.col("codigo_erp").alias("producto")),
        ["regla", "producto"], "left_semi",
    ).groupBy("regla", "producto").agg(F.sum("__q").alias("__q"))
    found = lookup(wanted, sold, {"id_item_regla": "regla", "codigo_erp": "producto"}, {"__q": "cantidad"})
    return found.groupBy("id_item_regla").agg(
        F.count("*").alias("productos"), F.count("cantidad").alias("vendidos"),
        F.count_if(F.col("cantidad") >= F.col("minimo")).alias("cumplidos"),
    )
