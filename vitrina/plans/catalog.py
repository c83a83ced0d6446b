"""Product catalogue summaries and catalogue search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.numbers import half_even, mean, total
from vitrina.operators.filters import between_days, containing, containing_any
from vitrina.operators.indexes import TrigramIndex
from vitrina.operators.ranking import descending, page, page_after, page_counts

PAGE_SIZE = 50


def catalog_summary(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count(F.lit(1)).alias("total_productos"),
        F.count_if(F.col("status") == 1).alias("activos"),
        F.countDistinct("marca").alias("marcas"),
        F.countDistinct("canal_id").alias("canales"),
        F.coalesce(half_even(mean("precio"), 2), F.lit(0.0)).alias("precio_promedio"),
    )


def products_by_brand(products: DataFrame) -> DataFrame:
    return (
        products.where(F.col("marca").isNotNull())
        .groupBy("marca")
        .agg(
            F.count("id").alias("total"),
            total("status").alias("activos"),
            half_even(mean("precio"), 2).alias("precio_promedio"),
        )
        .orderBy(*descending("total"), "marca")
    )


@dataclass(frozen=True)
class Catalog:
    """What can be filtered and searched in one catalogue, and how it is ordered."""

    filters: tuple[str, ...] = ()
    searched: tuple[str, ...] = ()
    day: str | None = None
    newest_first: str = "id"


# Searchable columns of each catalogue.
CATALOGS = {
    "ejecucion_marca": Catalog(
        ("nombre_marca", "supervisor"), ("nombre_marca", "user_real_name", "supervisor")
    ),
    "ejecucion_pdv": Catalog(("supervisor",), ("user_real_name", "supervisor", "incidencias")),
    "auditoria_marca": Catalog(
        ("nombre_marca", "supervisor"), ("nombre_marca", "user_real_name", "supervisor")
    ),
    "competencia": Catalog(
        ("marca", "supervisor"), ("marca", "user_real_name", "supervisor", "tipo_promo")
    ),
    "precios": Catalog(("supervisor",), ("user_real_name", "supervisor")),
    "promotores": Catalog((), ("user_real_name", "username", "email")),
    "cuadrillas": Catalog(
        ("agencia", "entidad"), ("nombre", "puesto", "agencia", "entidad", "region")
    ),
    "jornadas": Catalog((), ("incidencia",), day="fecha", newest_first="fecha"),
    "ausencias": Catalog((), ("nombre",)),
    "servicios": Catalog((), ("clave", "descripcion")),
}


def matching(
    df: DataFrame,
    catalog: Catalog,
    q: str | None = None,
    start: str | None = None,
    end: str | None = None,
    **filters: str | None,
) -> DataFrame:
    """Rows containing every filter value in its column and ``q`` in any searched column, without
    regard to case. Columns the table lacks are passed over."""
    if catalog.day:
        df = between_days(df, catalog.day, start, end)
    for column in catalog.filters:
        value = filters.get(column)
        if value and column in df.columns:
            df = df.where(containing(column, value))
    searched = [c for c in catalog.searched if c in df.columns]
    return df.where(containing_any(searched, q)) if q and searched else df


def build_index(df: DataFrame, catalog: Catalog, path: str) -> TrigramIndex:
    """Trigram index of every column of a catalogue that can be searched or filtered."""
    columns = [c for c in dict.fromkeys((*catalog.filters, *catalog.searched)) if c in df.columns]
    return TrigramIndex.build(df, columns, path)


def indexed_matching(
    index: TrigramIndex,
    catalog: Catalog,
    q: str | None = None,
    start: str | None = None,
    end: str | None = None,
    **filters: str | None,
) -> DataFrame:
    """What ``matching`` finds, from the rows that the trigrams name."""
    present = index.rows().columns
    conditions = [([c], filters[c]) for c in catalog.filters if filters.get(c) and c in present]
    searched = [c for c in catalog.searched if c in present]
    if q and searched:
        conditions.append((searched, q))
    found = index.search(conditions)
    return between_days(found, catalog.day, start, end) if catalog.day else found


def _order(df: DataFrame, catalog: Catalog) -> list[Column]:
    ties = ["id"] if catalog.newest_first != "id" and "id" in df.columns else []
    return descending(catalog.newest_first, *ties)


def search_page(found: DataFrame, catalog: Catalog, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    return page(found, _order(found, catalog), number, size)


def search_after(
    found: DataFrame, catalog: Catalog, last: tuple | None = None, size: int = PAGE_SIZE
) -> DataFrame:
    """The page behind the row whose ordering columns are ``last``; the first page without it. Works
    for catalogues ordered by columns that hold no NULL."""
    ties = ["id"] if catalog.newest_first != "id" and "id" in found.columns else []
    return page_after(found, [catalog.newest_first, *ties], last, size)


def search_counts(found: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    return page_counts(found, number, size)


def record_by_id(df: DataFrame, identifier: int) -> DataFrame:
    return df.where(F.col("id") == identifier)
