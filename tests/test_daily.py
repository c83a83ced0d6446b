"""Facts kept by day: only changed days are rebuilt, and the result is that of a full rebuild."""

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vitrina.plans import geofence, workday
from vitrina.sources import daily
from vitrina.sources.versions import CommitConflict, VersionedTable

VISITS = (
    "cliente_id long, usuario_id long, cuadrilla_id long, punto_venta_id long, fecha_planeada date, "
    "fecha_real_inicio timestamp, fecha_real_final timestamp, is_tarea boolean, is_no_planeada boolean, "
    "latitude_check_in double, longitude_check_in double, latitude_pdv double, longitude_pdv double, nota string"
)
DAYS = [None, *(date(2024, 1, 29) + timedelta(days=i) for i in range(6))]


@pytest.fixture(scope="module")
def dims(spark):
    stores = spark.createDataFrame(
        [(i, f"Suc {i}", "walmart", "CDMX", "S/A") for i in range(5)],
        "id long, sucursal string, cadena_str string, estado_str string, municipio_str string",
    )
    teams = spark.createDataFrame(
        [(i, f"T{i}", f"Ruta {i}", "R", " ") for i in range(3)], "id long, entidad string, ruta string, region string, plaza string"
    )
    users = spark.createDataFrame(
        [(i, 1, f"PRC{i}", f"Rep {i}") for i in range(4)], "id long, cliente_id long, username string, user_real_name string"
    )
    return stores, teams, users


def made_visits(spark, seed=1, rows=400):
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        day = rng.choice(DAYS)
        begin = datetime(2024, 1, 29, rng.randint(6, 18), rng.randint(0, 59))
        data.append(
            (
                rng.choice([1, 2, None]), rng.choice([0, 1, 2, 3, None]), rng.randrange(4), rng.choice([0, 1, 2, 3, 4, 9, None]), day,
                begin if rng.random() < 0.9 else None, begin + timedelta(minutes=rng.randint(-5, 90)),
                rng.random() < 0.3, rng.random() < 0.2, rng.choice([19.0, None, float("nan")]), -99.0, 19.1, -99.1, f"n{i}",
            )
        )
    # Rows that occur twice count twice.
    return spark.createDataFrame(data + data[:20], VISITS)


def bag(df, columns=None):
    return sorted((repr(tuple(r)) for r in df.select(*(columns or sorted(df.columns))).collect()))


def on_disk(visits, path):
    visits.write.partitionBy("fecha_planeada").parquet(path)
    return visits.sparkSession.read.schema(visits.schema).parquet(path)


def changed_day(visits, day):
    hit = (F.col("fecha_planeada") == F.lit(day)) & (F.col("cliente_id") == 1)
    return visits.withColumn("is_no_planeada", F.when(hit, ~F.col("is_no_planeada")).otherwise(F.col("is_no_planeada")))


def test_changed_days_alone_are_rebuilt(spark, tmp_path, dims, monkeypatch):
    stores, teams, _ = dims
    visits, path = on_disk(made_visits(spark), str(tmp_path / "visits")), str(tmp_path / "geo")
    first = geofence.refresh_enriched(visits, stores, teams, path)
    assert first.number == 1 and len(first.rebuilt) == len(DAYS) and not first.removed
    table = daily.daily_table(spark, path)
    full = geofence.enriched_visits(visits, stores, teams)
    assert bag(table.read()) == bag(full) and table.read().schema["dia"].dataType.simpleString() == "date"
    # Nothing changed: no commit. A column that the job does not read changes nothing either.
    assert geofence.refresh_enriched(visits, stores, teams, path) == daily.Refresh(1, (), ())
    assert geofence.refresh_enriched(visits.withColumn("nota", F.lit("x")), stores, teams, path).number == 1

    staged = []
    stage = VersionedTable.stage
    monkeypatch.setattr(VersionedTable, "stage", lambda self, df: staged.append(df) or stage(self, df))
    now = changed_day(visits, date(2024, 1, 31))
    assert geofence.refresh_enriched(now, stores, teams, path) == daily.Refresh(2, ("2024-01-31",), ())
    assert bag(table.read()) == bag(geofence.enriched_visits(now, stores, teams))
    plan = staged[0]._jdf.queryExecution().executedPlan().toString()
    filters = [f for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if "fecha_planeada" in f]
    assert filters and all("2024-01-31" in f for f in filters)
    before, after = table.manifest(1).partitions, table.manifest(2).partitions
    assert {p for p in after if before.get(p) != after[p]} == {"dia=2024-01-31"}


def test_new_lost_and_undated_days(spark, tmp_path, dims):
    stores, teams, _ = dims
    visits, path = made_visits(spark, 2), str(tmp_path / "geo")
    last = date(2024, 2, 3)
    geofence.refresh_enriched(visits.where(F.col("fecha_planeada") < F.lit(last)), stores, teams, path)
    table = daily.daily_table(spark, path)
    assert bag(table.read().where("dia IS NULL")) == []
    done = geofence.refresh_enriched(visits.where("fecha_planeada IS NULL OR fecha_planeada > '2024-01-29'"), stores, teams, path)
    assert done.rebuilt == ("2024-02-03", daily.NO_DAY) and done.removed == ("2024-01-29",)
    now = visits.where("fecha_planeada IS NULL OR fecha_planeada > '2024-01-29'")
    assert bag(table.read()) == bag(geofence.enriched_visits(now, stores, teams))
    emptied = geofence.refresh_enriched(visits.limit(0), stores, teams, path)
    assert not emptied.rebuilt and len(emptied.removed) == 6 and table.read().count() == 0
    assert geofence.refresh_enriched(visits, stores, teams, path).number == 4
    assert bag(table.read()) == bag(geofence.enriched_visits(visits, stores, teams))


def test_empty_source_first(spark, tmp_path, dims):
    stores, teams, _ = dims
    path = str(tmp_path / "geo")
    assert geofence.refresh_enriched(made_visits(spark).limit(0), stores, teams, path) == daily.Refresh(1, (), ())
    assert daily.daily_table(spark, path).read().count() == 0


def test_changed_attributes_rebuild_their_days(spark, tmp_path, dims):
    stores, teams, _ = dims
    visits = made_visits(spark, 3).where("punto_venta_id <> 2 OR fecha_planeada = '2024-01-30'").where("cuadrilla_id <> 1 OR fecha_planeada = '2024-02-01'")
    path = str(tmp_path / "geo")
    geofence.refresh_enriched(visits, stores, teams, path)
    table = daily.daily_table(spark, path)
    renamed = stores.withColumn("sucursal", F.when(F.col("id") == 2, None).otherwise(F.col("sucursal")))
    assert geofence.refresh_enriched(visits, renamed, teams, path).rebuilt == ("2024-01-30",)
    moved = teams.withColumn("region", F.when(F.col("id") == 1, "Q").otherwise(F.col("region")))
    assert geofence.refresh_enriched(visits, renamed, moved, path).rebuilt == ("2024-02-01",)
    # A store that was not known gets its name.
    known = renamed.union(spark.createDataFrame([(9, "Nueva", "x", "y", "z")], renamed.schema))
    geofence.refresh_enriched(visits, known, moved, path)
    assert bag(table.read()) == bag(geofence.enriched_visits(visits, known, moved))


def test_bounded_refresh_leaves_other_days(spark, tmp_path, dims):
    stores, teams, _ = dims
    visits, path = made_visits(spark, 4), str(tmp_path / "geo")
    geofence.refresh_enriched(visits, stores, teams, path)
    both = changed_day(changed_day(visits, date(2024, 1, 30)), date(2024, 2, 2)).where("fecha_planeada <> '2024-02-03'")
    done = geofence.refresh_enriched(both, stores, teams, path, start="2024-02-01", end="2024-02-03")
    assert done.rebuilt == ("2024-02-02",) and done.removed == ("2024-02-03",)
    # The day outside the range is still seen as changed, and rows without a day as gone.
    done = geofence.refresh_enriched(both, stores, teams, path)
    assert done.rebuilt == ("2024-01-30",) and done.removed == (daily.NO_DAY,)
    table = daily.daily_table(spark, path)
    assert bag(table.read()) == bag(geofence.enriched_visits(both, stores, teams))
    with pytest.raises(ValueError):
        daily.refresh_days(both, lambda v: v.select(F.col("fecha_planeada").alias("dia")), path, "fecha_planeada", start="2024-02-01")
    other = daily.refresh_days(both, lambda v: v.select(F.col("fecha_planeada").alias("dia"), "nota"), path, "fecha_planeada")
    assert len(other.rebuilt) == 5 and table.read().columns == ["nota", "dia"]


def test_reports_from_the_stored_days(spark, tmp_path, dims):
    _, teams, users = dims
    visits, path = made_visits(spark, 5), str(tmp_path / "days")
    workday.refresh_rep_days(visits, path)
    # One more visit makes a rep too busy, which takes out all of their days.
    per_day = visits.where("usuario_id = 1 AND cliente_id = 1 AND fecha_planeada = '2024-01-30'")
    more = visits.union(per_day.limit(1).withColumn("nota", F.lit("x")))
    limit = per_day.count()
    assert workday.refresh_rep_days(more, path).rebuilt == ("2024-01-30",)
    stored = daily.daily_table(spark, path).read()
    assert "fecha_real_inicio" not in stored.columns
    for job in (workday.rep_day_facts, workday.rep_kpis):
        assert bag(job(stored, users, teams, limit, collapsed=True)) == bag(job(more, users, teams, limit))
    assert bag(workday.daily_trend(stored, users, limit, collapsed=True)) == bag(workday.daily_trend(more, users, limit))


def visit_scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("fecha_planeada" in columns for columns in re.findall(r"FileScan parquet \[([^\]]*)\]", plan))


def test_busy_reps_from_the_stored_days(spark, tmp_path, dims):
    _, teams, users = dims
    visits, path = on_disk(made_visits(spark, 8), str(tmp_path / "visits")), str(tmp_path / "days")
    workday.refresh_rep_days(visits, path)
    days = daily.daily_table(spark, path).read()
    busiest = [r[0] for r in visits.where("usuario_id IS NOT NULL").groupBy("cliente_id", "usuario_id", "fecha_planeada").count().select("count").collect()]
    limit = sorted(busiest)[-3]
    assert 0 < workday.excluded_users(visits, users, limit).count() < 12
    assert bag(workday.excluded_users(visits, users, limit, days)) == bag(workday.excluded_users(visits, users, limit))
    for job in (workday.clean_visits, workday.itinerary):
        once = job(visits, users, teams, limit, days)
        assert bag(once) == bag(job(visits, users, teams, limit))
        assert visit_scans(once) == 1 and visit_scans(job(visits, users, teams, limit)) == 2


def test_second_of_two_refreshes_fails(spark, tmp_path, dims, monkeypatch):
    stores, teams, _ = dims
    visits, path = made_visits(spark, 6), str(tmp_path / "geo")
    geofence.refresh_enriched(visits, stores, teams, path)
    stage, raced = VersionedTable.stage, []

    def slow(self, df):
        written = stage(self, df)
        if not raced:
            raced.append(True)
            geofence.refresh_enriched(changed_day(visits, date(2024, 2, 1)), stores, teams, path)
        return written

    monkeypatch.setattr(VersionedTable, "stage", slow)
    with pytest.raises(CommitConflict):
        geofence.refresh_enriched(changed_day(visits, date(2024, 1, 30)), stores, teams, path)
    table = daily.daily_table(spark, path)
    assert table.versions() == [1, 2]
    assert bag(table.read()) == bag(geofence.enriched_visits(changed_day(visits, date(2024, 2, 1)), stores, teams))


def test_marks_tell_rows_apart(spark):
    def mark(*rows):
        frame = spark.createDataFrame([(date(2024, 1, 1), *r) for r in rows], "d date, a long, b long")
        return daily.day_marks(frame.repartition(3), "d").first().marca

    assert mark((1, 2), (3, 4)) == mark((3, 4), (1, 2))
    different = [mark((1, None)), mark((None, 1)), mark((1, None), (1, None)), mark((1, 2), (3, 4)), mark((1, 4), (3, 2)), mark((5, 5), (5, 5)), mark((6, 6), (6, 6))]
    assert len(set(different)) == len(different)
