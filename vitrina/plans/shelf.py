"""Shelf execution by store and brand: visits, planogram compliance, stock-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions.labels import NEAR_STOCKOUT_LIMIT, PLANOGRAM_LEVELS, STOCKOUT_LEVELS, level, over
from vitrina.functions.numbers import percent, total
from vitrina.operators.ranking import ascending, descending, listing, options, top
from vitrina.operators.reshape import melt

COUNTERS = (
    "total_visitas",
    "cant_sku",
    "cumple_planograma",
    "visitas_con_agotados",
    "cant_sku_agotados",
    "visitas_con_preagotados",
    "cant_sku_preagotados",
)

# Labels of the long stock-out table, products shown.
STOCKOUT_KINDS = {"pct_agotados": "Agotados", "pct_preagotados": "Preagotados"}
PRODUCTS_SHOWN = 4


def _known(df: DataFrame, *keys: str) -> DataFrame:
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def shelf_kpis(report: DataFrame) -> DataFrame:
    """One row of totals; percentages are 0 on empty input."""
    return (
        report.agg(
            F.countDistinct("punto_venta").alias("pdvs_unicos"),
            total("total_visitas").alias("total_visitas"),
            total("cant_sku").alias("total_sku"),
            total("cant_sku_agotados").alias("total_agotados"),
            total("cant_sku_preagotados").alias("total_preagotados"),
            total("cumple_planograma").alias("_cumple"),
        )
        .withColumn("pct_planograma", percent("_cumple", "total_visitas", empty=0.0))
        .withColumn("pct_agotados", percent("total_agotados", "total_sku", empty=0.0))
        .withColumn("pct_preagotados", percent("total_preagotados", "total_sku", empty=0.0))
        .drop("_cumple")
    )


def visits_by_brand(report: DataFrame) -> DataFrame:
    return (
        _known(report, "marca")
        .groupBy("marca")
        .agg(total("total_visitas").alias("total_visitas"))
        .orderBy("total_visitas", "marca")
    )


def planogram_by_brand(report: DataFrame) -> DataFrame:
    return (
        _known(report, "marca")
        .groupBy("marca")
        .agg(total("cumple_planograma").alias("planograma"), total("total_visitas").alias("visitas"))
        .withColumn("pct_planograma", percent("planograma", "visitas"))
        .orderBy("marca")
    )


def top_stores_visits(report: DataFrame, n: int = 10) -> DataFrame:
    keys = ["cadena", "punto_venta", "estado"]
    sums = _known(report, *keys).groupBy(*keys).agg(total("total_visitas").alias("total_visitas"))
    return top(sums, "total_visitas", keys, n)


def stockouts_by_brand(report: DataFrame) -> DataFrame:
    return (
        _known(report, "marca")
        .groupBy("marca")
        .agg(
            total("cant_sku_agotados").alias("sku_agotados"),
            total("cant_sku_preagotados").alias("sku_preagotados"),
            total("cant_sku").alias("sku"),
        )
        .withColumn("pct_agotados", percent("sku_agotados", "sku"))
        .withColumn("pct_preagotados", percent("sku_preagotados", "sku"))
        .orderBy("marca")
    )


def stockouts_by_brand_long(report: DataFrame) -> DataFrame:
    return melt(stockouts_by_brand(report), ["marca"], STOCKOUT_KINDS, "tipo", "pct")


def top_stores_stockouts(report: DataFrame, n: int = 10) -> DataFrame:
    sums = (
        _known(report, "punto_venta")
        .groupBy("punto_venta")
        .agg(total("cant_sku_agotados").alias("cant_sku_agotados"))
    )
    return top(sums, "cant_sku_agotados", ["punto_venta"], n)


def execution_summary(report: DataFrame, rows: int | None = None) -> DataFrame:
    """Counters by store and brand; ``rows`` cuts the listing for display only."""
    names = (
        "visitas",
        "sku",
        "planograma",
        "vis_agotados",
        "sku_agotados",
        "vis_preagotados",
        "sku_preagotados",
    )
    sums = report.groupBy("cadena", "punto_venta", "municipio", "estado", "marca").agg(
        *[F.sum(c).alias(name) for c, name in zip(COUNTERS, names, strict=True)]
    )
    return listing(sums, ascending("cadena", "punto_venta", "marca"), rows)


def execution_detail(summary: DataFrame) -> DataFrame:
    return (
        summary.withColumn("pct_planograma", percent("planograma", "visitas"))
        .withColumn("pct_agotados", percent("sku_agotados", "sku"))
        .withColumn("pct_preagotados", percent("sku_preagotados", "sku"))
    )


def brand_options(report: DataFrame) -> DataFrame:
    return options(report, "marca")


def chain_options(report: DataFrame) -> DataFrame:
    return options(report, "cadena")


# --- store-brand report -------------------------------------------------------------------------


def store_brand_report(report: DataFrame) -> DataFrame:
    """Counters and percentages by chain, store and brand. Store attributes are functionally
    dependent on the key; should they differ between rows, the largest is shown. They group the
    first pass, so that raw rows are hash-aggregated and only its few results are sorted."""

    def text(c: str):
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    attributes = ("punto_venta", "municipio", "estado")
    key = ["cadena", "pdv_id", "marca"]
    collapsed = report.groupBy(*key, *attributes).agg(*[total(c).alias(c) for c in COUNTERS])
    sums = collapsed.groupBy(*key).agg(
        *[F.max(c).alias(c) for c in attributes], *[F.sum(c).alias(c) for c in COUNTERS]
    )
    visits, sku = "total_visitas", "cant_sku"
    return sums.select(
        text("cadena"),
        "pdv_id",
        text("marca"),
        *[text(c) for c in attributes],
        *COUNTERS,
        percent("cumple_planograma", visits, empty=0.0).alias("pct_planograma"),
        percent("visitas_con_agotados", visits, empty=0.0).alias("pct_visitas_agotados"),
        percent("cant_sku_agotados", sku, empty=0.0).alias("pct_sku_agotados"),
        percent("visitas_con_preagotados", visits, empty=0.0).alias("pct_visitas_preagotados"),
        percent("cant_sku_preagotados", sku, empty=0.0).alias("pct_sku_preagotados"),
    )


def in_report_order(report: DataFrame) -> DataFrame:
    return report.orderBy("cadena", "punto_venta", "marca", *ascending("pdv_id"))


def with_levels(report: DataFrame) -> DataFrame:
    """Traffic lights of the store-brand report."""
    levels = {
        "nivel_planograma": level("pct_planograma", PLANOGRAM_LEVELS),
        "nivel_visitas_agotados": level("pct_visitas_agotados", STOCKOUT_LEVELS, higher_is_better=False),
        "nivel_sku_agotados": level("pct_sku_agotados", STOCKOUT_LEVELS, higher_is_better=False),
        "nivel_visitas_preagotados": over("pct_visitas_preagotados", NEAR_STOCKOUT_LIMIT, "yellow"),
        "nivel_sku_preagotados": over("pct_sku_preagotados", NEAR_STOCKOUT_LIMIT, "yellow"),
    }
    return report.withColumns(levels)


def products_at_risk(risk: DataFrame) -> DataFrame:
    """Every product seen out of stock (``agotados``) or nearly so (``preagotados``), one row per
    store, brand and product with the largest quantity of each."""
    quantity = {c: F.coalesce(F.col(f"cant_{c}"), F.lit(0)) for c in ("agotados", "preagotados")}
    return (
        risk.where(F.col("producto_en_riesgo").isNotNull() & ((quantity["agotados"] > 0) | (quantity["preagotados"] > 0)))
        .groupBy("punto_venta_id", "marca", "producto_en_riesgo")
        .agg(*[F.max(q).alias(c) for c, q in quantity.items()])
    )


def risk_products(risk: DataFrame, stores: DataFrame, shown: int = PRODUCTS_SHOWN) -> DataFrame:
    """Per reported store and brand: a view of ``products_at_risk`` with the first ``shown`` names of
    each class and the number of further ones. Names are ranked within their class in one pass over
    the products; only the few names shown are put together, the rest is counted."""
    kinds = ("agotados", "preagotados")
    group = Window.partitionBy("punto_venta_id", "marca")
    ranked = products_at_risk(risk).withColumns(
        {f"lugar_{c}": F.sum((F.col(c) > 0).cast("int")).over(group.orderBy("producto_en_riesgo")) for c in kinds}
    )

    def names(c: str):
        first = (F.col(c) > 0) & (F.col(f"lugar_{c}") <= shown)
        listed = F.sort_array(F.collect_list(F.when(first, F.col("producto_en_riesgo"))))
        return F.when(F.count_if(F.col(c) > 0) > 0, F.array_join(listed, ", ")).alias(c)

    def more(c: str):
        return F.greatest(F.count_if(F.col(c) > 0) - shown, F.lit(0)).alias(f"{c}_mas")

    lists = ranked.groupBy("punto_venta_id", "marca").agg(*[x for c in kinds for x in (names(c), more(c))])
    reported = stores.select(F.col("pdv_id").alias("punto_venta_id"), "marca").distinct()
    return lists.join(reported, ["punto_venta_id", "marca"], "left_semi")


def with_risk_products(report: DataFrame, products: DataFrame) -> DataFrame:
    """Report rows with their product lists; rows without products keep NULL lists."""
    right = products.withColumnRenamed("punto_venta_id", "pdv_id")
    return report.join(right, ["pdv_id", "marca"], "left")


def store_brand_totals(report: DataFrame) -> DataFrame:
    """One row over the store-brand report; an unknown store counts as one."""
    return (
        report.agg(
            total("total_visitas").alias("total_visitas"),
            total("cant_sku").alias("total_sku"),
            total("cant_sku_agotados").alias("total_agotados"),
            total("cant_sku_preagotados").alias("total_preagotados"),
            (
                F.countDistinct("pdv_id")
                + F.coalesce(F.max(F.col("pdv_id").isNull().cast("int")), F.lit(0))
            ).alias("pdvs_unicos"),
        )
        .withColumn("pct_agotados_gral", percent("total_agotados", "total_sku", empty=0.0))
        .withColumn("pct_pre_gral", percent("total_preagotados", "total_sku", empty=0.0))
    )


# --- execution detail and stock-out rate --------------------------------------------------------


def execution_by_rep(execution: DataFrame) -> DataFrame:
    return (
        _known(execution, "promotor")
        .groupBy("promotor")
        .agg(
            F.count("punto_venta_id").alias("visitas"),
            total("cant_agotados").alias("agotados"),
            total("cant_preagotados").alias("preagotados"),
            total("cant_sku").alias("sku"),
            total(F.col("planograma").cast("int")).alias("con_planograma"),
        )
        .orderBy(*descending("visitas"), "promotor")
    )


def execution_by_chain(execution: DataFrame) -> DataFrame:
    return (
        _known(execution, "cadena")
        .groupBy("cadena")
        .agg(
            F.count("punto_venta_id").alias("visitas"),
            F.countDistinct("punto_venta_id").alias("pdvs"),
            total("cant_agotados").alias("agotados"),
            total("cant_sku").alias("sku"),
        )
        .orderBy(*descending("visitas"), "cadena")
    )


def _stockout_rate(stockouts: DataFrame, keys: list[str], *extra) -> DataFrame:
    return (
        _known(stockouts, *keys)
        .groupBy(*keys)
        .agg(
            total("total_agotados").alias("total_agotados"), total("total_sku").alias("total_sku"), *extra
        )
        .withColumn("pct_quiebre", percent("total_agotados", "total_sku"))
    )


def stockout_rate_by_brand(stockouts: DataFrame) -> DataFrame:
    rates = _stockout_rate(stockouts, ["marca"], total("visitas").alias("visitas"))
    return rates.orderBy(*descending("pct_quiebre"), "marca")


def top_stores_stockout_rate(stockouts: DataFrame, n: int = 10) -> DataFrame:
    keys = ["punto_venta", "cadena", "estado"]
    return top(_stockout_rate(stockouts, keys), "pct_quiebre", keys, n)
