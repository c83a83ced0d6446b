"""Sell-out detail: totals, splits and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.clock import period_text, year_month
from vitrina.functions.numbers import amount, half_even, id_bits, ratio, total
from vitrina.operators.ranking import ascending, descending, top


def _sums():
    return [
        amount("venta").alias("venta"),
        amount("monto").alias("monto"),
        total("piezas").alias("piezas"),
    ]


def _by(sales: DataFrame, *keys: str, extra=()) -> DataFrame:
    known = sales
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*keys).agg(*_sums(), *extra)


def sellout_kpis(sales: DataFrame) -> DataFrame:
    """One row. Stores and products are counted from bitmaps with 64 ids to a word: each sale goes to the word of its
    store, with its amounts, and to that of its product. Words merge map-side, so a task holds a row per 64 ids and
    nothing is grouped by pairs of store and product. Ids are whole numbers; NULL ids count as none."""
    of_product = F.col("_de_producto")
    each = sales.withColumn("_de_producto", F.explode(F.array(F.lit(False), F.lit(True))))
    each = each.withColumn("_id", F.when(of_product, F.col("producto_id").cast("bigint")).otherwise(F.col("punto_venta_id").cast("bigint")))
    once = {c: F.when(~of_product, F.col(c)) for c in ("venta", "monto", "piezas", "precio")}
    words = each.groupBy("_de_producto", F.shiftright("_id", 6).alias("palabra")).agg(
        *[F.sum(x).alias(c) for c, x in once.items()], F.count(once["precio"]).alias("precios"), id_bits("_id").alias("bits")
    )
    return words.agg(
        half_even(amount("venta"), 2).alias("total_venta"),
        half_even(amount("monto"), 2).alias("total_monto"),
        total("piezas").alias("total_piezas"),
        total(F.when(~of_product, F.bit_count("bits"))).alias("pdvs_activos"),
        total(F.when(of_product, F.bit_count("bits"))).alias("productos"),
        F.coalesce(half_even(ratio(F.sum("precio"), F.sum("precios")), 2), F.lit(0.0)).alias("precio_promedio"),
    )


def sales_by_region(sales: DataFrame) -> DataFrame:
    stores = F.countDistinct("punto_venta_id").alias("pdvs")
    return _by(sales, "region", extra=[stores]).orderBy(*descending("venta"), "region")


def sales_by_channel(sales: DataFrame) -> DataFrame:
    return _by(sales, "canal_id").orderBy(*descending("venta"), "canal_id")


def top_products_sales(sales: DataFrame, n: int = 10) -> DataFrame:
    return top(_by(sales, "producto_id"), "venta", ["producto_id"], n)


def top_stores_sales(sales: DataFrame, n: int = 10) -> DataFrame:
    return top(_by(sales, "punto_venta_id"), "venta", ["punto_venta_id"], n)


def sales_monthly_trend(sales: DataFrame) -> DataFrame:
    return (
        _by(sales, "anio", "mes").withColumn("periodo", period_text()).orderBy(*ascending("anio", "mes"))
    )


def last_period(sales: DataFrame) -> DataFrame:
    """Last month with data, per client; year and month come from the same row."""
    return (
        sales.groupBy("cliente_id")
        .agg(F.max(year_month()).alias("anio_mes"))
        .select(
            "cliente_id",
            F.floor(F.col("anio_mes") / 100).cast("int").alias("anio"),
            (F.col("anio_mes") % 100).cast("int").alias("mes"),
        )
    )
