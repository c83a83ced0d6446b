from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vitrina.plans import workday
from vitrina.workload import adapters as a

VISIT = (
    "cliente_id BIGINT, usuario_id BIGINT, cuadrilla_id BIGINT, punto_venta_id BIGINT,"
    " fecha_real_inicio TIMESTAMP_NTZ, fecha_real_final TIMESTAMP_NTZ, is_tarea BOOLEAN,"
    " is_no_planeada BOOLEAN, dia STRING"
)


def at(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def world(spark):
    visits = [
        # rep 1: a 9 h day with a stop whose end precedes its start, then a day without any start
        (1, 1, 10, 100, at("2024-01-02 07:30:00"), at("2024-01-02 08:30:00"), True, False, "2024-01-02"),
        (1, 1, 10, 101, at("2024-01-02 12:00:00"), at("2024-01-02 11:50:00"), False, True, "2024-01-02"),
        (1, 1, 10, 101, at("2024-01-02 15:30:00"), at("2024-01-02 16:30:00"), False, False, "2024-01-02"),
        (1, 1, 10, 102, None, None, True, False, "2024-01-03"),
        # rep 2: a workday of 18 hours and another team
        (1, 2, 11, 100, at("2024-01-02 04:00:00"), at("2024-01-02 22:00:00"), False, False, "2024-01-02"),
        # rep 3: too busy; rep 4: dotted name; rep 5: dotted name of another client; unknown rep
        *[(1, 3, 10, 100, at("2024-01-02 09:00:00"), None, False, False, "2024-01-02")] * 4,
        (1, 4, 10, 100, at("2024-01-02 09:00:00"), None, False, False, "2024-01-02"),
        (1, 5, None, 100, at("2024-01-02 09:00:00"), None, False, False, "2024-01-02"),
        (1, None, 10, 100, at("2024-01-02 09:00:00"), None, False, False, "2024-01-02"),
    ]
    users = [(1, "PRC001", "Uno", 1), (2, None, "Dos", 1), (3, "PRC003", "Tres", 1), (4, "a.b", "C", 1), (5, "a.c", "D", 2)]
    teams = [(10, "Sur"), (10, "Norte"), (10, " "), (11, ""), (11, None)]
    return (
        spark.createDataFrame(visits, VISIT).withColumn("fecha_planeada", F.col("dia").cast("date")).drop("dia"),
        spark.createDataFrame(users, "id BIGINT, username STRING, user_real_name STRING, cliente_id BIGINT"),
        spark.createDataFrame(teams, "id BIGINT, entidad STRING"),
    )


def test_excluded_users(world, rows):
    visits, users, _ = world
    assert sorted(rows(workday.excluded_users(visits, users, 3))) == [(1, 3), (1, 4), (2, 5)]
    assert sorted(rows(workday.excluded_users(visits, users))) == [(1, 4), (2, 5)]


def test_rep_kpis(world):
    built = {r.usuario_id: r for r in workday.rep_kpis(*world, busy_limit=3).collect()}
    assert sorted(built) == [1, 2, 5]
    one, two, five = built[1], built[2], built[5]
    assert (one.entidad, two.entidad, five.entidad) == ("Norte", "Sin entidad", "Sin entidad")
    assert (one.dias_activos, one.ausencias, one.plan, one.realizadas_total) == (1, 1, 4, 3)
    assert (one.tareas_realizadas, one.tareas_planeadas) == (1, 2)
    assert (one.hora_inicio, one.hora_fin, one.pct_inicio, one.pct_fin) == ("07:30", "16:30", 100.0, 100.0)
    assert (one.t_laborado, one.t_pdv, one.t_traslado) == ("09:00", "02:00", "07:00")
    assert (one.pct_traslado, one.pct_pdv, one.visitas_prom, one.pct_visitas) == (78.0, 22.0, 3.0, 75.0)
    # longer than 16 hours: no usual workday, but time in store still counts
    assert (two.t_laborado, two.pct_traslado, two.t_pdv) == (None, None, "18:00")
    # no end: no workday
    assert (five.hora_fin, five.t_laborado, five.t_pdv, five.pct_fin) == (None, None, None, 0.0)


def test_collapsed_path_equals_row_path(spark, sf_dir):
    """Facts from collapsed visits equal facts from the joined visit rows."""
    args = (a.visits(spark, sf_dir), a.users(spark, sf_dir), a.teams(spark, sf_dir), a.BUSY_LIMIT)
    facts = workday.rep_day_facts(*args).select(
        "cliente_id", "usuario_id", "entidad", "dia", "planeadas", "realizadas"
    )
    rows = (
        workday.clean_visits(*args)
        .groupBy("cliente_id", "usuario_id", "entidad", "dia")
        .agg(F.count(F.lit(1)).alias("planeadas"), F.count("inicio").alias("realizadas"))
    )
    assert facts.exceptAll(rows).count() == 0
    assert rows.exceptAll(facts).count() == 0


def test_summary_team_and_status(world, rows):
    reps = workday.rep_kpis(*world, busy_limit=3)
    summary = workday.ops_summary(reps).first()
    assert (summary.promotores, summary.plan, summary.realizadas, summary.pct_visitas) == (3, 6, 5, 83.0)
    assert summary.hora_inicio == "06:50"  # mean of 07:30, 04:00 and 09:00
    assert (summary.pct_traslado, summary.visitas_prom) == (78, 1.7)
    teams = {r.entidad: r for r in workday.team_kpis(reps).collect()}
    assert (teams["Norte"].ausencias, teams["Norte"].tareas_planeadas) == (1, 2)
    assert (teams["Sin entidad"].promotores, teams["Sin entidad"].hora_inicio) == (2, "06:30")
    status = {r.usuario_id: r for r in workday.rep_status(reps).collect()}
    assert (status[1].puesto, status[1].nivel_equipo, status[2].puesto, status[2].nivel_equipo) == ("S", "yellow", "—", "green")


def test_daily_trend_and_itinerary(world, rows):
    visits, users, teams = world
    assert rows(workday.daily_trend(visits, users, 3), "promotores", "planeadas", "realizadas", "pct_cumplimiento") == [
        (3, 5, 5, 100.0),
        (1, 1, 0, 0.0),
    ]
    built = workday.itinerary(visits, users, teams, 3)
    first = [r for r in built.collect() if r.usuario_id == 1][0]
    assert (first.hora_entrada, first.hora_salida, first.pdvs_visitados, first.fuera_de_ruta) == ("07:30", "16:30", 2, 1)
    assert rows(workday.itinerary_totals(built)) == [(4, 6, 5, 1)]
    assert rows(workday.itinerary_totals(built, "Uno", "2024-01-03")) == [(1, 1, 0, 0)]
    assert rows(workday.itinerary_totals(built, "Todos", "Todas")) == [(4, 6, 5, 1)]
    assert rows(workday.itinerary_totals(built, "Nadie")) == [(0, 0, 0, 0)]


def test_last_activity_day_bounds_years_only_where_asked(world, rows):
    visits, _, _ = world
    odd = visits.withColumn("fecha_planeada", F.when(F.col("usuario_id") == 2, F.lit("2099-01-01").cast("date")).otherwise(F.col("fecha_planeada")))
    assert str(workday.last_activity_day(odd).first().ultima) == "2099-01-01"
    row = workday.last_activity_day(odd, 2015, 2026).first()
    assert (str(row.ultima), str(row.desde)) == ("2024-01-03", "2024-01-01")
