"""Observed prices, own against competitor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.labels import COMPETITOR, OWN, price_kind
from vitrina.functions.numbers import half_even, mean, ratio, total
from vitrina.operators.filters import between_days, chosen, containing
from vitrina.operators.quantiles import exact_quantiles
from vitrina.operators.ranking import ascending, descending, listing


def price_kpis(prices: DataFrame) -> DataFrame:
    """One row, from prices collapsed on product, chain and owner. Rows with an unknown owner are in
    neither class."""
    collapsed = prices.groupBy("producto", "cadena", "is_propio").agg(
        F.count(F.lit(1)).alias("filas"), F.sum("precio").alias("precio"), F.count("precio").alias("precios")
    )
    own, other = F.col("is_propio") == 1, F.col("is_propio") == 0

    def mean_price(condition):
        sums = [F.sum(F.when(condition, F.col(c))) for c in ("precio", "precios")]
        return F.coalesce(half_even(ratio(*sums), 2), F.lit(0.0))

    def products(condition):
        return F.countDistinct(F.when(condition, F.col("producto")))

    return collapsed.agg(
        total("filas").alias("total_registros"),
        mean_price(own).alias("precio_promedio_propio"),
        mean_price(other).alias("precio_promedio_competencia"),
        products(own).alias("productos_propios"),
        products(other).alias("productos_competencia"),
        F.countDistinct("cadena").alias("cadenas_monitoreadas"),
    )


def with_kind(prices: DataFrame) -> DataFrame:
    return prices.withColumn("tipo", price_kind())


def price_by_type(prices: DataFrame) -> DataFrame:
    return (
        with_kind(prices)
        .groupBy("tipo")
        .agg(half_even(mean("precio"), 2).alias("precio"))
        .orderBy("tipo")
    )


def price_by_category(prices: DataFrame) -> DataFrame:
    return (
        with_kind(prices)
        .where(F.col("categoria").isNotNull())
        .groupBy("categoria", "tipo")
        .agg(half_even(mean("precio"), 2).alias("precio"))
        .orderBy("categoria", "tipo")
    )


def price_distribution(prices: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum of the price by type."""
    summary = {"minimo": 0.0, "q1": 0.25, "mediana": 0.5, "q3": 0.75, "maximo": 1.0}
    return exact_quantiles(with_kind(prices), ["tipo"], "precio", summary)


def active_prices(
    prices: DataFrame,
    start: str | None = None,
    end: str | None = None,
    chain: str | None = None,
    product: str | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Active prices of a period; ``kind`` is ``propio`` or ``competencia``."""
    kept = between_days(prices.where(F.col("status")), "fecha", start, end)
    kept = chosen(kept, cadena=chain)
    if product:
        kept = kept.where(containing("producto", product))
    if kind in ("propio", "competencia"):
        kept = kept.where(F.col("is_propio") == int(kind == "propio"))
    return kept


def price_listing(prices: DataFrame, rows: int | None = None) -> DataFrame:
    columns = with_kind(prices).select(
        "producto", "categoria", "cadena", "precio", "tipo", "fecha", "promotor"
    )
    return listing(columns, [*ascending("producto", "cadena"), *descending("fecha")], rows)


def price_listing_counts(prices: DataFrame) -> DataFrame:
    """One row over all filtered prices, not only the listed ones."""
    return with_kind(prices).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("tipo") == OWN).alias("propios"),
        F.count_if(F.col("tipo") == COMPETITOR).alias("competencia"),
    )
