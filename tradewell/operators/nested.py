"""Flattening nested feed arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewell.functions.text import strip_text


def flatten_stock(
    products: DataFrame, settings: DataFrame, company: str = "empresa_erp",
    stores: str = "Bodegas", lists: str = "Items",
) -> DataFrame:
    """One row per product and allowed warehouse.

    ``settings`` has one row per company: ``empresa_erp``, ``bodegas_permitidas`` (array) and
    ``lista_precio_permitida`` (null: any). Warehouses are filtered inside the row before it
    is repeated. Missing, null and empty warehouse arrays give no rows; a product without
    price lists fails a price-list test.
    """
    allowed = settings.select(
        F.col("empresa_erp").alias("__company"), "bodegas_permitidas", "lista_precio_permitida"
    )
    on_list = F.coalesce(
        F.exists(lists, lambda i: strip_text(i["OCODLISTA"]) == F.col("lista_precio_permitida")),
        F.lit(False),
    )
    kept = F.filter(
        stores, lambda b: F.array_contains(F.col("bodegas_permitidas"), b["OCODBODEGA"])
    )
    # One row per configured company, so the broadcast has a fixed size.
    return (
        products.join(F.broadcast(allowed), F.col(company) == F.col("__company"))
        .filter(F.col("lista_precio_permitida").isNull() | on_list)
        .withColumn("__store", F.explode(kept))
        .withColumn("cod_bodega_erp", F.col("__store.OCODBODEGA"))
        .withColumn("existencia", F.col("__store.OEXISTENCIA"))
        .drop("__store", "__company", "bodegas_permitidas", "lista_precio_permitida", stores, lists)
    )
