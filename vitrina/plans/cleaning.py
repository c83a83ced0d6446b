"""Exported views (all text) to typed, curated tables. Row-wise projections only: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.clock import with_calendar
from vitrina.functions.labels import (
    PLANOGRAM_BINS,
    STOCKOUT_BINS,
    at_least,
    binned,
    bit,
    price_kind_or_unknown,
)
from vitrina.functions.numbers import half_even, ratio
from vitrina.functions.text import or_default

# Compliance a day's plan has to reach.
PLAN_TARGET = 80


def _each(df: DataFrame, columns: tuple[str, ...], change) -> DataFrame:
    """Apply ``change`` to the listed columns the table has."""
    return df.withColumns({c: change(c) for c in columns if c in df.columns})


def moments(df: DataFrame, *columns: str) -> DataFrame:
    return _each(df, columns, lambda c: F.col(c).try_cast("timestamp_ntz"))


def numbers(df: DataFrame, *columns: str) -> DataFrame:
    return _each(df, columns, lambda c: F.col(c).try_cast("double"))


def bits(df: DataFrame, *columns: str) -> DataFrame:
    return _each(df, columns, bit)


def texts(df: DataFrame, *columns: str) -> DataFrame:
    return _each(df, columns, or_default)


def clean_operations(view: DataFrame) -> DataFrame:
    df = moments(view, "fecha", "inicio_jornada", "fin_jornada")
    df = with_calendar(df, "fecha", week=True, day_name=True)
    df = numbers(df, "horas_laboradas", "pct_cumplimiento_plan", "pct_cumplimiento_visitas")
    df = df.withColumn("cumple_plan", at_least("pct_cumplimiento_plan", PLAN_TARGET))
    return texts(df, "puesto", "agencia", "supervisor", "entidad", "incidencia")


def clean_execution(view: DataFrame) -> DataFrame:
    df = moments(view, "fecha")
    df = bits(
        df, "con_agotados", "con_preagotados", "planograma", "negocicacion", "is_degustacion", "status"
    )
    df = with_calendar(df, "fecha", week=True)
    df = df.withColumn("pct_sku_agotados", _share("cant_agotados", "cant_sku"))
    return texts(df, "nombre_marca", "cadena", "punto_venta", "municipio", "estado")


def _share(part: str, whole: str) -> Column:
    share = ratio(F.col(part).try_cast("double"), F.col(whole).try_cast("double"))
    return half_even(share * F.lit(100.0), 2)


def clean_stockouts(view: DataFrame) -> DataFrame:
    month = F.to_date(F.try_to_timestamp("anio_mes", F.lit("yyyy-MM")))
    df = view.withColumns({"anio": F.year(month), "mes": F.month(month)})
    df = texts(df, "marca", "cadena", "punto_venta", "estado", "municipio")
    return df.withColumn("nivel_quiebre", binned(F.col("pct_quiebre").try_cast("double"), STOCKOUT_BINS))


def clean_risk_products(view: DataFrame) -> DataFrame:
    df = moments(view, "fecha")
    return texts(df, "marca", "cadena", "punto_venta", "estado", "producto_en_riesgo")


def clean_zero_sales(view: DataFrame) -> DataFrame:
    df = bits(moments(view, "fecha"), "ejecutada")
    df = numbers(with_calendar(df, "fecha"), "inventario")
    return texts(df, "marca", "cadena", "punto_venta", "estado", "producto", "promotor")


def clean_prices(view: DataFrame) -> DataFrame:
    df = bits(moments(view, "fecha"), "is_propio", "status")
    df = numbers(with_calendar(df, "fecha"), "precio")
    df = df.withColumn("tipo_precio", price_kind_or_unknown())
    return texts(df, "producto", "categoria", "cadena", "punto_venta", "estado", "promotor")


def clean_brand_report(view: DataFrame) -> DataFrame:
    df = with_calendar(moments(view, "fecha"), "fecha", week=True)
    df = numbers(
        df,
        "pct_planograma",
        "pct_visitas_agotados",
        "pct_sku_agotados",
        "pct_visitas_preagotados",
        "pct_sku_preagotados",
    )
    df = df.withColumn("nivel_planograma", binned("pct_planograma", PLANOGRAM_BINS))
    return texts(df, "cadena", "punto_venta", "municipio", "estado", "marca")
