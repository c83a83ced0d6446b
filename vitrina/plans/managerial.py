"""Managerial compliance report by store or chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.labels import MANAGERIAL_LEVELS, MANAGERIAL_STOCKOUT_LIMIT, level, over
from vitrina.functions.numbers import percent
from vitrina.operators.lookups import named_or_id, with_attributes
from vitrina.operators.ranking import ascending


def _numbers(executions: DataFrame, compliant: str, out: str, sku: str) -> DataFrame:
    """The three measures as numbers, 0 when missing or unreadable."""

    def number(c: str):
        source = F.col(c)
        if executions.schema[c].dataType.simpleString() == "boolean":
            source = source.cast("int")
        return F.coalesce(source.try_cast("bigint"), F.lit(0))

    return executions.withColumns(
        {"_cumple": number(compliant), "_agotados": number(out), "_sku": number(sku)}
    )


def managerial_report(
    executions: DataFrame,
    chains: DataFrame,
    stores: DataFrame,
    by: str = "pdv",
    compliant: str = "planograma",
    out: str = "cant_agotados",
    sku: str = "cant_sku",
) -> DataFrame:
    """Visits, compliance and stock-outs per chain and store (``by="pdv"``) or per chain
    (``by="cadena"``), worst compliance first. Rows collapse on the ids before names are joined."""
    ids = ["cadena_id", "punto_venta_id"] if by == "pdv" else ["cadena_id"]
    measures = {"cumple_planograma": "_cumple", "sku_agotados": "_agotados", "total_sku": "_sku"}
    per_id = (
        _numbers(executions, compliant, out, sku)
        .groupBy(*ids)
        .agg(F.count("id").alias("visitas"), *[F.sum(c).alias(n) for n, c in measures.items()])
    )
    named = with_attributes(per_id, chains, "cadena_id", {"_cadena": "nombre"})
    keys = {"nombre_cadena": named_or_id("_cadena", "cadena_id")}
    if by == "pdv":
        named = with_attributes(named, stores, "punto_venta_id", {"_pdv": "nombre"})
        keys["nombre_pdv"] = named_or_id("_pdv", "punto_venta_id")
    return (
        named.withColumns(keys)
        .groupBy(*keys)
        .agg(F.sum("visitas").alias("visitas"), *[F.sum(n).alias(n) for n in measures])
        .withColumn("pct_cumplimiento", percent("cumple_planograma", "visitas", 2))
        .withColumn("pct_agotados", percent("sku_agotados", "total_sku", 2, empty=0.0))
        .orderBy(*ascending("pct_cumplimiento", *keys))
    )


def with_levels(report: DataFrame) -> DataFrame:
    """Traffic lights of compliance and of stock-outs."""
    return report.withColumns(
        {
            "nivel_cumplimiento": level("pct_cumplimiento", MANAGERIAL_LEVELS),
            "nivel_agotados": over("pct_agotados", MANAGERIAL_STOCKOUT_LIMIT, "red"),
        }
    )


def managerial_totals(
    executions: DataFrame,
    compliant: str = "planograma",
    out: str = "cant_agotados",
    sku: str = "cant_sku",
) -> DataFrame:
    """One row; zeros on empty input."""
    return (
        _numbers(executions, compliant, out, sku)
        .agg(
            F.count(F.lit(1)).alias("visitas"),
            F.sum("_cumple").alias("_cumple"),
            F.sum("_agotados").alias("_agotados"),
            F.sum("_sku").alias("_sku"),
        )
        .select(
            "visitas",
            percent("_cumple", "visitas", 2, empty=0.0).alias("cumplimiento"),
            percent("_agotados", "_sku", 2, empty=0.0).alias("agotados"),
        )
    )
