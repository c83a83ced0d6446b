"""Geofence compliance: enriched visits, distances, anomalies."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.clock import clock_text
from vitrina.functions.geo import (
    ALERT,
    AMBER_METRES,
    CRITICAL,
    IN_RANGE,
    RED_METRES,
    distance_class,
    distance_metres,
    usable,
)
from vitrina.functions.numbers import mean, percent
from vitrina.functions.text import clean_chain, clean_municipality, clean_state
from vitrina.operators.filters import between_days, chosen, plausible_years
from vitrina.operators.lookups import one_row_per_id, with_attributes
from vitrina.operators.quantiles import exact_quantiles
from vitrina.operators.ranking import ascending, descending, options
from vitrina.sources.daily import Refresh, refresh_days
from vitrina.sources.tables import write_parquet

# Display names of the visit listing.
DETAIL_LABELS = {
    "fecha": "Fecha",
    "promotor": "Promotor",
    "ruta": "Ruta",
    "estado": "Estado",
    "municipio": "Municipio",
    "punto_venta": "Punto de venta",
    "cadena": "Cadena",
    "hora_checkin": "Hora check-in",
    "distancia_metros": "Distancia (m)",
    "estado_geo": "Estatus",
    "es_fuera_ruta": "Fuera de ruta",
}


# Columns of the visit table that the enrichment reads.
VISIT_COLUMNS = [
    "cliente_id",
    "usuario_id",
    "cuadrilla_id",
    "punto_venta_id",
    "fecha_planeada",
    "fecha_real_inicio",
    "latitude_check_in",
    "longitude_check_in",
    "latitude_pdv",
    "longitude_pdv",
    "is_no_planeada",
]
TEAM_COLUMNS = ["ruta", "entidad", "region", "plaza"]


def _located(
    visits: DataFrame, clients: list[int] | None, first_year: int | None, last_year: int | None
) -> DataFrame:
    located = plausible_years(visits, "fecha_planeada", first_year, last_year).where(
        F.col("fecha_real_inicio").isNotNull()
        & usable("latitude_check_in")
        & usable("longitude_check_in")
        & F.col("latitude_pdv").isNotNull()
        & F.col("longitude_pdv").isNotNull()
    )
    return located if clients is None else located.where(F.col("cliente_id").isin(clients))


def _store_attributes() -> dict[str, str | Column]:
    return {
        "sucursal": "sucursal",
        "cadena": clean_chain("cadena_str"),
        "estado": clean_state("estado_str"),
        "municipio": clean_municipality("municipio_str"),
    }


def _placed(located: DataFrame, stores: DataFrame, teams: DataFrame) -> DataFrame:
    in_store = with_attributes(located, stores, "punto_venta_id", _store_attributes())
    team_rows = one_row_per_id(teams, "entidad", "ruta", "region", "plaza")
    placed = with_attributes(in_store, team_rows, "cuadrilla_id", {c: c for c in TEAM_COLUMNS})
    return placed.select(
        "cliente_id",
        "usuario_id",
        "cuadrilla_id",
        F.col("fecha_planeada").alias("dia"),
        "punto_venta_id",
        F.col("fecha_real_inicio").alias("hora_checkin"),
        F.col("latitude_check_in").alias("lat_checkin"),
        F.col("longitude_check_in").alias("lon_checkin"),
        F.col("latitude_pdv").alias("lat_pdv"),
        F.col("longitude_pdv").alias("lon_pdv"),
        F.col("is_no_planeada").cast("int").alias("es_fuera_ruta"),
        *_store_attributes(),
        *TEAM_COLUMNS,
    )


def enriched_visits(
    visits: DataFrame,
    stores: DataFrame,
    teams: DataFrame,
    clients: list[int] | None = None,
    first_year: int | None = None,
    last_year: int | None = None,
) -> DataFrame:
    """Started visits with usable coordinates, plus store and team attributes. Names are
    normalised on the store table, before the join, not once per visit. Years are bounded only
    where the caller says so."""
    return _placed(_located(visits, clients, first_year, last_year), stores, teams)


def _days_with_old(stored: DataFrame, dim: DataFrame, key: str, attributes: dict[str, str | Column]) -> DataFrame:
    """Days with rows whose stored attributes are no longer those of the dimension. The ids that changed are
    found on distinct (id, attributes); only their days are looked up after that."""
    kept = stored.select(key, *attributes).distinct()
    now = with_attributes(kept, dim, key, {f"_{name}": source for name, source in attributes.items()})
    differs = [~F.col(name).eqNullSafe(F.col(f"_{name}")) for name in attributes]
    changed = now.where(reduce(or_, differs)).select(key).distinct()
    return stored.join(changed, key, "left_semi").select("dia")


def refresh_enriched(
    visits: DataFrame,
    stores: DataFrame,
    teams: DataFrame,
    path: str,
    clients: list[int] | None = None,
    first_year: int | None = None,
    last_year: int | None = None,
    start: str | None = None,
    end: str | None = None,
) -> Refresh:
    """Bring the enriched visits kept by day under ``path`` up to date in one commit. Built anew are the days
    whose counted visits changed and the days with a store or team whose attributes changed; with ``start`` and
    ``end`` only days between them. ``daily_table(spark, path).read()`` gives the result."""

    def outdated(stored: DataFrame) -> DataFrame:
        team_rows = one_row_per_id(teams, "entidad", "ruta", "region", "plaza")
        return _days_with_old(stored, stores, "punto_venta_id", _store_attributes()).union(
            _days_with_old(stored, team_rows, "cuadrilla_id", {c: c for c in TEAM_COLUMNS})
        )

    located = _located(visits, clients, first_year, last_year).select(VISIT_COLUMNS)
    return refresh_days(
        located, lambda rows: _placed(rows, stores, teams), path, "fecha_planeada", start=start, end=end, stale=outdated
    )


def write_enriched(geo: DataFrame, path: str) -> None:
    """All clients in one pass, one partition folder per client."""
    write_parquet(geo, path, ("cliente_id",))


def geo_period(geo: DataFrame) -> DataFrame:
    """First and last day per client."""
    return geo.groupBy("cliente_id").agg(F.min("dia").alias("dia_min"), F.max("dia").alias("dia_max"))


def filtered(
    geo: DataFrame, start: str | None = None, end: str | None = None, **values: object
) -> DataFrame:
    """Day range plus equality on ``estado``, ``municipio``, ``cadena``, ``ruta``, ``cliente_id``."""
    return chosen(between_days(geo, "dia", start, end), **values)


def state_options(geo: DataFrame, **filters: object) -> DataFrame:
    return options(filtered(geo, **filters), "estado")


def municipality_options(geo: DataFrame, **filters: object) -> DataFrame:
    return options(filtered(geo, **filters), "municipio")


def chain_options(geo: DataFrame, **filters: object) -> DataFrame:
    return options(filtered(geo, **filters), "cadena")


def route_options(geo: DataFrame, **filters: object) -> DataFrame:
    return options(filtered(geo, **filters), "ruta")


def visit_distances(geo: DataFrame, users: DataFrame) -> DataFrame:
    """Visits with the rep's name and the distance from store to check-in."""
    named = with_attributes(geo, users, "usuario_id", {"promotor": "user_real_name"})
    return named.select(
        "cliente_id",
        "usuario_id",
        "promotor",
        F.col("dia").alias("fecha"),
        "punto_venta_id",
        F.col("sucursal").alias("punto_venta"),
        "cadena",
        "estado",
        "municipio",
        "ruta",
        "lat_pdv",
        "lon_pdv",
        F.col("lat_checkin").alias("lat_promotor"),
        F.col("lon_checkin").alias("lon_promotor"),
        "es_fuera_ruta",
        "hora_checkin",
        distance_metres("lat_checkin", "lon_checkin", "lat_pdv", "lon_pdv").alias("distancia_metros"),
    )


def classified(
    distances: DataFrame, amber: float = AMBER_METRES, red: float = RED_METRES
) -> DataFrame:
    return distances.withColumn("estado_geo", distance_class("distancia_metros", amber, red))


def geo_kpis(visits: DataFrame) -> DataFrame:
    """Per client: visits, in range, share in range, alerts, critical."""
    return (
        visits.groupBy("cliente_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("estado_geo") == IN_RANGE).alias("en_rango"),
            F.count_if(F.col("estado_geo") == ALERT).alias("alerta"),
            F.count_if(F.col("estado_geo") == CRITICAL).alias("critico"),
        )
        .withColumn("pct_en_rango", percent("en_rango", "total", 1, empty=0.0))
    )


def map_points(visits: DataFrame) -> DataFrame:
    """Visits that can be drawn: usable store coordinates."""
    return visits.where(usable("lat_pdv") & usable("lon_pdv"))


def map_center(visits: DataFrame) -> DataFrame:
    """Median store coordinate per client, from visits collapsed to store positions."""
    positions = (
        map_points(visits)
        .groupBy("cliente_id", "lat_pdv", "lon_pdv")
        .agg(F.count(F.lit(1)).alias("visitas"))
    )
    lat = exact_quantiles(positions, ["cliente_id"], "lat_pdv", {"lat": 0.5}, "visitas")
    lon = exact_quantiles(positions, ["cliente_id"], "lon_pdv", {"lon": 0.5}, "visitas")
    return lat.join(lon, "cliente_id")


def _anomalies(visits: DataFrame, key: str):
    return (
        visits.where(F.col(key).isNotNull())
        .groupBy("cliente_id", key)
        .agg(
            F.count("usuario_id").alias("visitas"),
            F.count_if(F.col("estado_geo") == CRITICAL).alias("criticas"),
            F.count_if(F.col("estado_geo") == ALERT).alias("alertas"),
            mean("distancia_metros").alias("dist_promedio"),
        )
    )


def anomalies_by_rep(visits: DataFrame) -> DataFrame:
    return (
        _anomalies(visits, "promotor")
        .withColumn("pct_anomalas", percent(F.col("criticas") + F.col("alertas"), "visitas"))
        .orderBy(*descending("criticas"), *ascending("cliente_id", "promotor"))
    )


def anomalies_by_route(visits: DataFrame) -> DataFrame:
    return (
        _anomalies(visits, "ruta")
        .drop("dist_promedio")
        .orderBy(*descending("criticas"), *ascending("cliente_id", "ruta"))
    )


def critical_list(visits: DataFrame) -> DataFrame:
    """Alerts and critical visits, farthest first."""
    return (
        visits.where(F.col("estado_geo").isin(CRITICAL, ALERT))
        .select(
            "fecha",
            "promotor",
            "ruta",
            "punto_venta",
            "cadena",
            "estado",
            "municipio",
            "distancia_metros",
            "estado_geo",
        )
        .orderBy(*descending("distancia_metros"), *ascending("fecha", "promotor", "punto_venta"))
    )


def visit_detail(visits: DataFrame, only_anomalies: bool = False) -> DataFrame:
    """Listing with the check-in time, newest day first. The check-in moment and the store are
    sorted on as well, so that the visits of one rep and day can be split between tasks."""
    rows = visits.where(F.col("estado_geo").isin(CRITICAL, ALERT)) if only_anomalies else visits
    ordered = rows.orderBy(
        *descending("fecha"), *ascending("promotor", "hora_checkin", "punto_venta_id")
    )
    return ordered.select(
        "fecha",
        "promotor",
        "ruta",
        "estado",
        "municipio",
        "punto_venta",
        "cadena",
        clock_text("hora_checkin").alias("hora_checkin"),
        "distancia_metros",
        "estado_geo",
        "es_fuera_ruta",
    )
