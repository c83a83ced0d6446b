"""Store inventory: coverage and over-stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.clock import period_text
from vitrina.functions.numbers import amount, half_even, mean, percent, ratio, total
from vitrina.operators.ranking import ascending, descending, top

_DAYS = "dias_inventario_prom"


def _mean_days():
    return half_even(mean("dias_inventario"), 1).alias(_DAYS)


def inventory_kpis(stock: DataFrame) -> DataFrame:
    """One row, from stock collapsed on store and product."""
    collapsed = stock.groupBy("punto_venta_id", "producto_id").agg(
        *[F.sum(c).alias(c) for c in ("existencia", "venta", "is_sobre_inventario", "dias_inventario")],
        F.count("dias_inventario").alias("con_dias"),
        F.count(F.lit(1)).alias("filas"),
    )
    return collapsed.agg(
        half_even(amount("existencia"), 2).alias("existencia_total"),
        half_even(ratio(F.sum("dias_inventario"), F.sum("con_dias")), 1).alias(_DAYS),
        total("is_sobre_inventario").alias("sobre_inventario"),
        percent(F.sum("is_sobre_inventario"), F.sum("filas"), 1, empty=0.0).alias("pct_sobre_inventario"),
        F.countDistinct("punto_venta_id").alias("pdvs_monitoreados"),
        F.countDistinct("producto_id").alias("productos_monitoreados"),
        half_even(amount("venta"), 2).alias("venta_total"),
    )


def inventory_by_region(stock: DataFrame) -> DataFrame:
    return (
        stock.where(F.col("region").isNotNull())
        .groupBy("region")
        .agg(
            amount("existencia").alias("existencia"),
            _mean_days(),
            total("is_sobre_inventario").alias("sobre_inventario"),
            F.countDistinct("punto_venta_id").alias("pdvs"),
        )
        .orderBy(*descending("existencia"), "region")
    )


def overstock_products(stock: DataFrame, n: int = 10) -> DataFrame:
    cases = (
        stock.where((F.col("is_sobre_inventario") == 1) & F.col("producto_id").isNotNull())
        .groupBy("producto_id")
        .agg(
            F.count("id").alias("casos"), amount("existencia").alias("existencia_total"), _mean_days()
        )
    )
    return top(cases, "casos", ["producto_id"], n)


def stock_vs_sales(stock: DataFrame) -> DataFrame:
    """Stock over sales by product; NULL for a product without sales."""
    return (
        stock.where(F.col("producto_id").isNotNull())
        .groupBy("producto_id")
        .agg(amount("existencia").alias("existencia"), amount("venta").alias("venta"), _mean_days())
        .withColumn("ratio_inv_venta", half_even(ratio(F.col("existencia"), F.col("venta")), 2))
        .orderBy(*descending("existencia"), "producto_id")
    )


def inventory_monthly_trend(stock: DataFrame) -> DataFrame:
    return (
        stock.where(F.col("anio").isNotNull() & F.col("mes").isNotNull())
        .groupBy("anio", "mes")
        .agg(
            amount("existencia").alias("existencia"),
            _mean_days(),
            total("is_sobre_inventario").alias("sobre_inventario"),
        )
        .withColumn("periodo", period_text())
        .orderBy(*ascending("anio", "mes"))
    )
