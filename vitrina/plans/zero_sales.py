"""Zero-sales alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.numbers import amount, percent, total
from vitrina.functions.text import or_default
from vitrina.operators.ranking import ascending, fixed_order, listing

# Brand order of the report sections.
BRAND_ORDER = ["FAGE", "LIFEWAY", "CALIFIA", "FORAGER", "OTRA"]
OTHER_BRAND = "OTRA"


def _executed():
    return F.count_if(F.col("ejecutada").cast("boolean"))


def _not_executed():
    """Known not to be executed; an unknown state is in neither class."""
    return F.count_if(~F.col("ejecutada").cast("boolean"))


def zero_sales_kpis(alerts: DataFrame) -> DataFrame:
    """One row, from alerts collapsed on brand and store."""
    collapsed = alerts.groupBy("marca", "punto_venta").agg(
        F.count(F.lit(1)).alias("filas"), _executed().alias("si"), _not_executed().alias("no")
    )
    return collapsed.agg(
        total("filas").alias("total_registros"),
        total("si").alias("ejecutadas"),
        total("no").alias("pendientes"),
        F.countDistinct("marca").alias("marcas_afectadas"),
        F.countDistinct("punto_venta").alias("pdvs_afectados"),
    ).withColumn("pct_ejecutado", percent("ejecutadas", "total_registros", empty=0.0))


def zero_sales_by_brand(alerts: DataFrame) -> DataFrame:
    return (
        alerts.where(F.col("marca").isNotNull())
        .groupBy("marca")
        .agg(F.count(F.lit(1)).alias("registros"))
        .orderBy("marca")
    )


def zero_sales_status(alerts: DataFrame) -> DataFrame:
    return alerts.agg(_executed().alias("ejecutada"), _not_executed().alias("pendiente"))


def zero_sales_listing(alerts: DataFrame, rows: int | None = None) -> DataFrame:
    columns = alerts.select(
        "marca",
        "producto",
        "cadena",
        "punto_venta",
        "estado",
        "inventario",
        "ejecutada",
        "fecha",
        "promotor",
    )
    return listing(columns, ascending("marca", "producto", "cadena"), rows)


def _report_counts():
    """Report figures: what is not executed, known or not, is pending."""
    return [
        F.count(F.lit(1)).alias("total_productos"),
        _executed().alias("ejecutados"),
        (F.count(F.lit(1)) - _executed()).alias("pendientes"),
        amount("inventario").alias("inv_total"),
    ]


def zero_sales_totals(alerts: DataFrame) -> DataFrame:
    """One row; an unknown store counts as one."""
    unknown = F.coalesce(F.max(F.col("punto_venta_id").isNull().cast("int")), F.lit(0))
    return alerts.agg(
        *_report_counts(), (F.countDistinct("punto_venta_id") + unknown).alias("pdvs_afectados")
    )


def zero_sales_sections(alerts: DataFrame, order: list[str] = BRAND_ORDER) -> DataFrame:
    """One row per brand in the fixed order, other brands after it."""
    return (
        alerts.withColumn("marca", or_default("marca", OTHER_BRAND))
        .groupBy("marca")
        .agg(*_report_counts(), F.countDistinct("producto").alias("productos"))
        .withColumn("orden", fixed_order("marca", order))
        .orderBy("orden", "marca")
    )
