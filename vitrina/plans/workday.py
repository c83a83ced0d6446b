"""Field operations: rep workdays, visit compliance, itineraries.

The visit table is by far the largest input, so every report starts by collapsing it on
(client, rep, team, day) with map-side aggregation and only then meets teams and reps. A rep with
a third of all visits is a handful of rows per task after that step. The collapsed rows are hashed
by rep once, after the team join, and every later step groups by rep and reuses that placement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.functions.clock import (
    MICROS_PER_HOUR,
    MICROS_PER_SECOND,
    hhmm,
    hhmm_from_minutes,
    hours,
    micros_between,
    micros_of_day,
    minutes_of,
)
from vitrina.functions.labels import VISIT_LEVELS, is_supervisor, level
from vitrina.functions.numbers import half_even, half_up, mean, percent
from vitrina.functions.text import or_default
from vitrina.operators.filters import chosen, plausible_years
from vitrina.operators.lookups import marked_unique, unique_by_id, with_attributes
from vitrina.operators.ranking import ascending
from vitrina.sources.daily import Refresh, refresh_days

# Default limits of the reports.
BUSY_VISITS_PER_DAY = 50
START_TARGET_SECONDS = 8 * 3600
WORKDAY_TARGET_HOURS = 8
WORKDAY_MAX_HOURS = 16
NO_TEAM = "Sin entidad"

# Display names of the itinerary.
ITINERARY_LABELS = {
    "fecha": "Fecha",
    "username": "Usuario",
    "promotor": "Promotor",
    "entidad": "Entidad",
    "hora_entrada": "Entrada",
    "hora_salida": "Salida",
    "visitas_planeadas": "Planeadas",
    "visitas_realizadas": "Realizadas",
    "pdvs_visitados": "PDVs",
    "fuera_de_ruta": "Fuera ruta",
}

REP = ["cliente_id", "usuario_id"]

# Columns of the visit table that the day facts read.
VISIT_COLUMNS = [
    *REP,
    "cuadrilla_id",
    "fecha_planeada",
    "fecha_real_inicio",
    "fecha_real_final",
    "is_tarea",
    "is_no_planeada",
]


# --- exclusions ---------------------------------------------------------------------------------


def _is_system_name(username: str, own_client: Column) -> Column:
    """A dotted user name of the same client marks an auditor or system account."""
    return F.coalesce(F.col(username).contains(".") & own_client, F.lit(False))


def excluded_users(
    visits: DataFrame, users: DataFrame, busy_limit: int = BUSY_VISITS_PER_DAY, days: DataFrame | None = None
) -> DataFrame:
    """Reps left out of the reports: more than ``busy_limit`` visits on any day, or a dotted name. With the
    stored day table of the same visits (``refresh_rep_days``) as ``days`` the visits are not read."""
    if days is not None:
        per_day = days.groupBy(*REP, "dia").agg(F.sum("planeadas").alias("count"))
    else:
        per_day = visits.where(F.col("usuario_id").isNotNull()).groupBy(*REP, "fecha_planeada").count()
    busy = per_day.groupBy(*REP).agg(F.max("count").alias("n")).where(F.col("n") > busy_limit)
    named = unique_by_id(users).where(F.col("username").contains(".")).select(
        "cliente_id", F.col("id").alias("usuario_id")
    )
    return busy.select(*REP).union(named).distinct()


def _without(visits: DataFrame, excluded: DataFrame) -> DataFrame:
    """Visits of known reps that are not excluded. A NULL client is a client of its own here, as it
    is in every grouping."""
    gone = excluded.select(F.col("cliente_id").alias("_cliente"), F.col("usuario_id").alias("_usuario"))
    same = (F.col("usuario_id") == F.col("_usuario")) & F.col("cliente_id").eqNullSafe(F.col("_cliente"))
    return visits.where(F.col("usuario_id").isNotNull()).join(gone, same, "left_anti")


def clean_visits(
    visits: DataFrame,
    users: DataFrame,
    teams: DataFrame,
    busy_limit: int = BUSY_VISITS_PER_DAY,
    days: DataFrame | None = None,
) -> DataFrame:
    """Visit rows of counted reps with rep and team attributes and the minutes spent in store. ``days``, the
    stored day table, saves the scan for busy reps."""
    counted = _without(visits, excluded_users(visits, users, busy_limit, days))
    named = with_attributes(
        counted, users, "usuario_id", {"username": "username", "user_real_name": "user_real_name"}
    )
    placed = with_attributes(named, _team_names(teams), "cuadrilla_id", {"entidad": "entidad"})
    micros = micros_between("fecha_real_inicio", "fecha_real_final")
    return placed.select(
        *REP,
        "username",
        "user_real_name",
        "entidad",
        F.col("fecha_planeada").alias("dia"),
        F.col("fecha_real_inicio").alias("inicio"),
        F.col("fecha_real_final").alias("fin"),
        "is_tarea",
        (micros / F.lit(60.0 * MICROS_PER_SECOND)).alias("min_en_pdv"),
    )


def _team_names(teams: DataFrame) -> DataFrame:
    named = teams.where(F.trim("entidad") != "")
    return marked_unique(named.groupBy("id").agg(F.min("entidad").alias("entidad")))


# --- collapsed visits ---------------------------------------------------------------------------


def _collapsed(visits: DataFrame, *extra: str) -> DataFrame:
    start, end = F.col("fecha_real_inicio"), F.col("fecha_real_final")
    micros = micros_between(start, end)
    return (
        visits.where(F.col("usuario_id").isNotNull())
        .groupBy(*REP, "cuadrilla_id", F.col("fecha_planeada").alias("dia"), *extra)
        .agg(
            F.count(F.lit(1)).alias("planeadas"),
            F.count(start).alias("realizadas"),
            F.count_if(F.col("is_tarea") & start.isNotNull()).alias("tareas_realizadas"),
            F.count_if("is_tarea").alias("tareas_planeadas"),
            F.count_if("is_no_planeada").alias("fuera_de_ruta"),
            F.min(micros_of_day(start)).alias("us_inicio"),
            F.max(micros_of_day(end)).alias("us_fin"),
            F.min(start).alias("primera"),
            F.max(end).alias("ultima"),
            F.sum(F.greatest(micros, F.lit(0))).alias("us_en_pdv"),
        )
    )


def _counted(collapsed: DataFrame, users: DataFrame, busy_limit: int) -> DataFrame:
    """Collapsed rows of counted reps with their names. The busiest day of a rep comes from the
    collapsed rows themselves, so the visits are scanned once."""
    by_rep = collapsed.repartition("usuario_id")
    day = Window.partitionBy("usuario_id", "cliente_id", "dia")
    rep = Window.partitionBy("usuario_id", "cliente_id")
    busiest = (
        by_rep.withColumn("_en_dia", F.sum("planeadas").over(day))
        .withColumn("_maximo", F.max("_en_dia").over(rep))
        .where(F.col("_maximo") <= busy_limit)
        .drop("_en_dia", "_maximo")
    )
    named = with_attributes(
        busiest,
        users,
        "usuario_id",
        {
            "username": "username",
            "user_real_name": "user_real_name",
            "_cliente": "cliente_id",
        },
    )
    own = F.col("_cliente").eqNullSafe(F.col("cliente_id"))
    return named.where(~_is_system_name("username", own)).drop("_cliente")


def refresh_rep_days(visits: DataFrame, path: str, start: str | None = None, end: str | None = None) -> Refresh:
    """Bring the visits kept under ``path``, collapsed on (client, rep, team, day), up to date in one commit: days
    whose visits changed are collapsed anew. What depends on other days or on names (busy reps, teams) is left
    to the reports, which take ``daily_table(spark, path).read()`` with ``collapsed=True``."""
    counted = visits.where(F.col("usuario_id").isNotNull()).select(VISIT_COLUMNS)
    return refresh_days(counted, _collapsed, path, "fecha_planeada", start=start, end=end)


def _rep_days(
    visits: DataFrame, users: DataFrame, teams: DataFrame, busy_limit: int, collapsed: bool = False
) -> DataFrame:
    in_team = with_attributes(
        visits if collapsed else _collapsed(visits), _team_names(teams), "cuadrilla_id", {"entidad": "entidad"}
    )
    merged = _counted(in_team, users, busy_limit).groupBy(*REP, "username", "user_real_name", "entidad", "dia").agg(
        *[
            F.sum(c).alias(c)
            for c in ("planeadas", "realizadas", "tareas_realizadas", "tareas_planeadas")
        ],
        F.min("us_inicio").alias("us_inicio"),
        F.max("us_fin").alias("us_fin"),
        F.min("primera").alias("primera"),
        F.max("ultima").alias("ultima"),
        F.coalesce(F.sum("us_en_pdv"), F.lit(0)).alias("us_en_pdv"),
    )
    span = F.when(F.col("ultima") > F.col("primera"), micros_between("primera", "ultima"))
    return (
        merged.withColumn("us_jornada", span)
        .withColumn("us_en_pdv", F.least("us_en_pdv", "us_jornada"))
        .drop("primera", "ultima")
    )


def rep_day_facts(
    visits: DataFrame,
    users: DataFrame,
    teams: DataFrame,
    busy_limit: int = BUSY_VISITS_PER_DAY,
    collapsed: bool = False,
) -> DataFrame:
    """One row per rep, team and day: planned and done visits, first start, last end, workday
    and in-store hours (never more than the workday). ``collapsed``: ``visits`` is the stored day table."""
    second = F.lit(float(MICROS_PER_SECOND))
    return _rep_days(visits, users, teams, busy_limit, collapsed).select(
        *REP,
        "username",
        "user_real_name",
        "entidad",
        "dia",
        "planeadas",
        "realizadas",
        "tareas_realizadas",
        "tareas_planeadas",
        (F.col("us_inicio") / second).alias("seg_inicio"),
        (F.col("us_fin") / second).alias("seg_fin"),
        hours("us_jornada").alias("horas_jornada"),
        hours("us_en_pdv").alias("horas_en_pdv"),
    )


# --- reports per rep and team -------------------------------------------------------------------


def rep_kpis(
    visits: DataFrame,
    users: DataFrame,
    teams: DataFrame,
    busy_limit: int = BUSY_VISITS_PER_DAY,
    start_target: int = START_TARGET_SECONDS,
    workday_target: int = WORKDAY_TARGET_HOURS,
    workday_max: int = WORKDAY_MAX_HOURS,
    collapsed: bool = False,
) -> DataFrame:
    """One row per client, rep and team with workday and compliance figures. ``collapsed``: ``visits`` is the
    stored day table."""
    active = F.col("realizadas") > 0
    usual = (F.col("us_jornada") > 0) & (F.col("us_jornada") <= workday_max * MICROS_PER_HOUR)
    moving = F.col("us_jornada") - F.col("us_en_pdv")

    def seconds_mean(condition: Column, micros: Column) -> Column:
        return mean(F.when(condition, micros)) / F.lit(float(MICROS_PER_SECOND))

    def share(condition: Column) -> Column:
        return percent(F.count_if(condition), F.count_if(active), 0, half_up)

    def usual_share(micros: Column) -> Column:
        part = micros.cast("double") / F.col("us_jornada") * F.lit(100.0)
        return half_up(F.avg(F.when(usual, part)), 0)

    return (
        _rep_days(visits, users, teams, busy_limit, collapsed)
        .groupBy(*REP, "username", "user_real_name", "entidad")
        .agg(
            F.count_if(active).alias("dias_activos"),  # facts hold one row per day
            F.count_if((F.col("realizadas") == 0) & (F.col("planeadas") > 0)).alias("ausencias"),
            F.sum("tareas_realizadas").alias("tareas_realizadas"),
            F.sum("tareas_planeadas").alias("tareas_planeadas"),
            hhmm(seconds_mean(active, F.col("us_inicio"))).alias("hora_inicio"),
            share(active & (F.col("us_inicio") <= start_target * MICROS_PER_SECOND)).alias("pct_inicio"),
            hhmm(seconds_mean(active, F.col("us_fin"))).alias("hora_fin"),
            share(F.col("us_jornada") >= workday_target * MICROS_PER_HOUR).alias("pct_fin"),
            hhmm(seconds_mean(usual, F.col("us_jornada"))).alias("t_laborado"),
            hhmm(seconds_mean(usual, moving)).alias("t_traslado"),
            usual_share(moving).alias("pct_traslado"),
            hhmm(seconds_mean(F.col("us_en_pdv") > 0, F.col("us_en_pdv"))).alias("t_pdv"),
            usual_share(F.col("us_en_pdv")).alias("pct_pdv"),
            half_up(mean(F.when(active, F.col("realizadas"))), 1).alias("visitas_prom"),
            F.sum("planeadas").alias("plan"),
            F.sum("realizadas").alias("realizadas_total"),
            percent(F.sum("realizadas"), F.sum("planeadas"), 0, half_up).alias("pct_visitas"),
        )
        .withColumn("entidad", or_default("entidad", NO_TEAM))
    )


def in_report_order(reps: DataFrame) -> DataFrame:
    return reps.orderBy(*ascending("cliente_id", "entidad", "username", "usuario_id"))


def absences_in_period(workdays: DataFrame) -> DataFrame:
    """Workday records that carry an absence, per client."""
    return (
        workdays.where(F.col("ausencia_id").isNotNull())
        .groupBy("cliente_id")
        .agg(F.count(F.lit(1)).alias("ausencias"))
    )


_TIMES = ("hora_inicio", "hora_fin", "t_laborado", "t_traslado", "t_pdv")


def _mean_times() -> list[Column]:
    """Unweighted means over reps of minute-truncated times."""
    return [hhmm_from_minutes(mean(minutes_of(c))).alias(c) for c in _TIMES]


def _mean_of_tenths(c: str) -> Column:
    return mean(F.col(c).cast("decimal(10,1)"))


def ops_summary(reps: DataFrame) -> DataFrame:
    """One row per client over the rep report."""
    return reps.groupBy("cliente_id").agg(
        F.countDistinct("usuario_id").alias("promotores"),
        F.sum("plan").alias("plan"),
        F.sum("realizadas_total").alias("realizadas"),
        percent(F.sum("realizadas_total"), F.sum("plan"), 0, half_even, empty=0.0).alias("pct_visitas"),
        *_mean_times(),
        F.coalesce(half_even(mean("pct_inicio"), 0), F.lit(0.0)).alias("pct_inicio"),
        F.coalesce(half_even(mean("pct_fin"), 0), F.lit(0.0)).alias("pct_fin"),
        F.coalesce(F.floor(mean("pct_traslado")), F.lit(0)).cast("bigint").alias("pct_traslado"),
        F.coalesce(F.floor(mean("pct_pdv")), F.lit(0)).cast("bigint").alias("pct_pdv"),
        half_even(_mean_of_tenths("visitas_prom"), 1).alias("visitas_prom"),
    )


def team_kpis(reps: DataFrame) -> DataFrame:
    """One row per client and team over the rep report."""
    return reps.groupBy("cliente_id", "entidad").agg(
        F.countDistinct("usuario_id").alias("promotores"),
        F.sum("plan").alias("plan"),
        F.sum("realizadas_total").alias("realizadas"),
        F.sum("tareas_realizadas").alias("tareas_realizadas"),
        F.sum("tareas_planeadas").alias("tareas_planeadas"),
        F.sum("ausencias").alias("ausencias"),
        percent(F.sum("realizadas_total"), F.sum("plan"), 0).alias("pct_visitas"),
        *_mean_times(),
        *[half_even(mean(c), 0).alias(c) for c in ("pct_inicio", "pct_fin", "pct_traslado", "pct_pdv")],
        half_even(_mean_of_tenths("visitas_prom"), 1).alias("visitas_prom"),
    )


def rep_status(reps: DataFrame) -> DataFrame:
    """Reps with their role and the traffic light of their team's visit compliance."""
    team = reps.groupBy("cliente_id", "entidad").agg(
        F.count(F.lit(1)).alias("promotores"),
        percent(F.sum("realizadas_total"), F.sum("plan"), 0, half_even, empty=0.0).alias("pct_equipo"),
    ).withColumnsRenamed({"cliente_id": "_cliente", "entidad": "_entidad"})
    same = F.col("cliente_id").eqNullSafe(F.col("_cliente")) & F.col("entidad").eqNullSafe(F.col("_entidad"))
    return reps.join(team, same, "left").select(
        *REP,
        "username",
        "entidad",
        F.when(is_supervisor(), "S").otherwise("—").alias("puesto"),
        "pct_visitas",
        "promotores",
        "pct_equipo",
        level("pct_equipo", VISIT_LEVELS).alias("nivel_equipo"),
    )


# --- reports per day ----------------------------------------------------------------------------


def daily_trend(
    visits: DataFrame, users: DataFrame, busy_limit: int = BUSY_VISITS_PER_DAY, collapsed: bool = False
) -> DataFrame:
    """Per client and day: reps, planned and done visits, compliance. ``collapsed``: ``visits`` is the stored
    day table."""
    per_rep = (
        _counted(visits if collapsed else _collapsed(visits), users, busy_limit)
        .groupBy(*REP, "dia")
        .agg(F.sum("planeadas").alias("planeadas"), F.sum("realizadas").alias("realizadas"))
    )
    return (
        per_rep.groupBy("cliente_id", "dia")
        .agg(
            F.count(F.lit(1)).alias("promotores"),
            F.sum("planeadas").alias("planeadas"),
            F.sum("realizadas").alias("realizadas"),
        )
        .withColumn("pct_cumplimiento", percent("realizadas", "planeadas", 1, half_up))
        .orderBy("cliente_id", "dia")
    )


def itinerary(
    visits: DataFrame,
    users: DataFrame,
    teams: DataFrame,
    busy_limit: int = BUSY_VISITS_PER_DAY,
    days: DataFrame | None = None,
) -> DataFrame:
    """Per day and rep: entry, exit, planned, done, stores and off-route visits. ``days``, the stored day table,
    saves the scan for busy reps."""
    # Store visits of a system account are unbounded, so those reps go first; what is left is at
    # most ``busy_limit`` rows per rep and day.
    counted = _collapsed(_without(visits, excluded_users(visits, users, busy_limit, days)), "punto_venta_id")
    in_team = with_attributes(counted, _team_names(teams), "cuadrilla_id", {"entidad": "entidad"})
    named = with_attributes(
        in_team, users, "usuario_id", {"username": "username", "user_real_name": "user_real_name"}
    )
    second = F.lit(float(MICROS_PER_SECOND))
    return (
        named.groupBy(*REP, "username", "user_real_name", "entidad", "dia")
        .agg(
            hhmm(F.min("us_inicio") / second).alias("hora_entrada"),
            hhmm(F.max("us_fin") / second).alias("hora_salida"),
            F.sum("planeadas").alias("visitas_planeadas"),
            F.sum("realizadas").alias("visitas_realizadas"),
            F.countDistinct("punto_venta_id").alias("pdvs_visitados"),
            F.sum("fuera_de_ruta").alias("fuera_de_ruta"),
        )
        .select(
            F.col("dia").alias("fecha"),
            *REP,
            "username",
            F.col("user_real_name").alias("promotor"),
            or_default("entidad", NO_TEAM).alias("entidad"),
            "hora_entrada",
            "hora_salida",
            "visitas_planeadas",
            "visitas_realizadas",
            "pdvs_visitados",
            "fuera_de_ruta",
        )
        .orderBy(*ascending("fecha", "username", "usuario_id", "entidad"))
    )


def itinerary_totals(
    rows: DataFrame, promotor: str | None = None, fecha: str | None = None
) -> DataFrame:
    """One row over the itinerary, optionally of one rep and one day."""
    picked = chosen(rows, promotor=promotor)
    if fecha is not None and fecha != "Todas":
        picked = picked.where(F.col("fecha") == F.lit(fecha).cast("date"))
    return picked.agg(
        F.count(F.lit(1)).alias("dias"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("visitas_planeadas", "visitas_realizadas", "fuera_de_ruta")
        ],
    )


def last_activity_day(
    visits: DataFrame, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Last planned day, within the years given, and the first day of its month, per client."""
    return (
        plausible_years(visits, "fecha_planeada", first_year, last_year)
        .where(F.col("fecha_planeada").isNotNull())
        .groupBy("cliente_id")
        .agg(F.max("fecha_planeada").alias("ultima"))
        .withColumn("desde", F.trunc("ultima", "MM"))
    )
