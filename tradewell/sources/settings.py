"""Per-company settings as a small frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Company:
    name: str
    warehouses: tuple[str, ...]
    price_list: str | None = None


LAYOUT = "empresa_erp string, bodegas_permitidas array<string>, lista_precio_permitida string"


def company_settings(spark: SparkSession, companies: list[Company]) -> DataFrame:
    return spark.createDataFrame(
        [(c.name, list(c.warehouses), c.price_list) for c in companies], LAYOUT
    )


