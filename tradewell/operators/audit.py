"""Coverage audits: what is active but not yet managed, as a work list to fill in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.functions.dates import months_before
from tradewell.operators.quality import unmatched


def recently_active(fact: DataFrame, key: str, day: str, as_of: Column, months: int) -> DataFrame:
    """Distinct keys with activity since ``months`` before ``as_of``, that day included."""
    return fact.filter(F.col(day) >= months_before(as_of, months)).select(key).distinct()


def not_managed(active: DataFrame, managed: DataFrame, keys: list[str]) -> DataFrame:
    """Active rows whose key is not among the managed ones; null keys equal null keys."""
    return unmatched(active, managed, {k: k for k in keys}, null_safe=True)


def work_list(df: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """Report columns in order: filled from a column, or blank to be filled by hand."""
    return df.select(*[
        (F.col(source) if source else F.lit("")).alias(name) for name, source in columns.items()
    ])


def pending_products(
    products: DataFrame, sales: DataFrame, stock: DataFrame, managed: DataFrame, as_of: Column,
    sales_months: int = 12, stock_months: int = 3,
) -> DataFrame:
    """Products sold or in stock recently whose code and reference nobody has classified.

    Expects the warehouse columns of dim_productos, hechos_ventas, inventario_actual and
    gestion_productos_aux.
    """
    active_ids = (
        recently_active(sales, "id_producto_fk", "fecha_sk", as_of, sales_months)
        .union(recently_active(
            stock, "id_producto_fk", "fecha_ultima_actualizacion", as_of, stock_months
        ))
        .distinct()
    )
    named = products.select("id_producto", "codigo_erp", "referencia", "descripcion_erp")
    active = named.join(
        active_ids, F.col("id_producto") == F.col("id_producto_fk"), "left_semi"
    ).select("codigo_erp", "referencia", "descripcion_erp").distinct()
    done = products.select("id_producto", "codigo_erp", "referencia").join(
        managed, F.col("id_producto") == F.col("id_producto_fk"), "left_semi"
    )
    return work_list(not_managed(active, done, ["codigo_erp", "referencia"]), {
        "codigo_erp": "codigo_erp", "referencia": "referencia", "categoria_gestion": None,
        "subcategoria_1_gestion": None, "subcategoria_2_gestion": None,
        "descripcion_guia": "descripcion_erp", "clasificacion_py": None,
        "equivalencia_py": None, "peso_neto": None,
    })


def pending_clients(
    clients: DataFrame, sales: DataFrame, as_of: Column, months: int = 24
) -> DataFrame:
    """Clients with recent sales that are not linked to a master client."""
    active = recently_active(sales, "id_cliente_empresa_fk", "fecha_sk", as_of, months)
    unlinked = clients.filter(F.col("id_maestro_cliente_fk").isNull()).join(
        active, F.col("id_cliente_empresa") == F.col("id_cliente_empresa_fk"), "left_semi"
    ).select("nit", "nombre_erp", "cod_cliente_erp", "empresa_erp").distinct()
    return work_list(unlinked, {
        "cod_cliente_maestro": "cod_cliente_erp", "nit": "nit", "nombre_unificado": "nombre_erp",
        "canal": None, "subcanal": None, "cod_cliente_erp_origen": "cod_cliente_erp",
        "empresa_erp_origen": "empresa_erp",
    })
