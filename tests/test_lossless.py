"""Nothing is lost by default: years, long spans, repeated ids, unknown clients, emptied months."""

import re
from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from vitrina.functions import clock
from vitrina.operators.filters import between_months, plausible_years
from vitrina.operators.lookups import unique_by_id, with_attributes
from vitrina.operators.ranking import page_after
from vitrina.plans import geofence, inventory, managerial, prices, rollup, sellout, shelf, workday, zero_sales
from vitrina.schemas import SCHEMAS
from vitrina.session import shared_dir, shuffle_width
from vitrina.sources import dump, views
from vitrina.workload import adapters as a
from vitrina.workload.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hours_beyond_99(spark, rows):
    df = spark.createDataFrame([(361_800,), (28_800,), (540,)], "s bigint").select(clock.hhmm("s").alias("t"))
    assert rows(df) == [("100:30",), ("08:00",), ("00:09",)]
    minutes = df.select(clock.minutes_of("t").alias("m"))
    assert rows(minutes) == [(6030,), (480,), (9,)]
    odd = spark.createDataFrame([("8:00",), ("1234",), ("ab:cd",), (None,)], "t string")
    assert rows(odd.select(clock.minutes_of("t"))) == [(None,)] * 4


def test_years_are_bounded_only_where_asked_and_at_the_scan(spark, sf_dir, tmp_path):
    df = spark.createDataFrame([(date(2014, 12, 31),), (date(2015, 1, 1),), (date(2027, 6, 1),)], "d date")
    assert plausible_years(df, "d").count() == 3
    assert plausible_years(df, "d", 2015).count() == 2 and plausible_years(df, "d", 2015, 2026).count() == 1
    df.write.parquet(str(tmp_path / "d"))
    pushed = plan(plausible_years(spark.read.parquet(str(tmp_path / "d")), "d", 2015, 2026))
    assert "GreaterThanOrEqual(d,2015-01-01)" in pushed and "LessThan(d,2027-01-01)" in pushed


def test_month_range_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(2023, 12, 1), (2024, 1, 2), (2024, 2, 3)], "anio int, mes int, v int").write.parquet(str(tmp_path / "m"))
    picked = between_months(spark.read.parquet(str(tmp_path / "m")), 202312, 202401)
    assert sorted(r.v for r in picked.collect()) == [1, 2]
    assert "GreaterThanOrEqual(anio,2023)" in plan(picked) and "LessThanOrEqual(anio,2024)" in plan(picked)


def test_repeated_ids_do_not_repeat_rows(spark, rows):
    dim = spark.createDataFrame([(1, None, 5), (1, "b", 7), (1, "b", 6), (2, None, None), (None, "x", 1)], "id long, n string, k int")
    assert sorted(rows(unique_by_id(dim)), key=str) == [(1, "b", 6), (2, None, None)]
    fact = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "x long")
    assert sorted(rows(with_attributes(fact, dim, "x", {"n": "n"})), key=str) == [(1, "b"), (1, "b"), (2, None), (3, None), (None, None)]


VISIT = "cliente_id long, usuario_id long, cuadrilla_id long, punto_venta_id long, fecha_planeada date, " \
    "fecha_real_inicio timestamp_ntz, fecha_real_final timestamp_ntz, is_tarea boolean, is_no_planeada boolean"


def test_unknown_clients_are_treated_alike(spark):
    visit = (None, 1, 1, 1, date(2027, 1, 2), None, None, False, False)
    visits = spark.createDataFrame([visit] * 60 + [(None, 2, *visit[2:])] * 3, VISIT)
    users = spark.createDataFrame([(1, "u1", "A", None), (2, "u2", "B", None)], "id long, username string, user_real_name string, cliente_id long")
    teams = spark.createDataFrame([(1, "T")], "id long, entidad string")
    reps = workday.rep_kpis(visits, users, teams)
    assert [r.usuario_id for r in reps.collect()] == [2]
    assert [r.promotores for r in workday.daily_trend(visits, users).collect()] == [1]
    assert [r.usuario_id for r in workday.itinerary(visits, users, teams).collect()] == [2]
    assert {r.usuario_id for r in workday.clean_visits(visits, users, teams).collect()} == {2}
    assert [r.usuario_id for r in workday.rep_status(reps).collect()] == [2]
    assert str(workday.last_activity_day(visits).first().ultima) == "2027-01-02"


def test_emptied_months_leave_the_stored_rollup(spark, tmp_path):
    sales = spark.range(1, 4).select(
        F.lit(1).cast("long").alias("cliente_id"), F.lit(2024).alias("anio"), F.col("id").cast("int").alias("mes"),
        *[F.lit(1).cast("long").alias(c) for c in ("canal_id", "cadena_id", "producto_id", "punto_venta_id", "piezas")],
        F.lit(5).cast("decimal(18,2)").alias("monto"),
    )
    path = str(tmp_path / "rollup")
    rollup.refresh_rollup(sales, path)
    rollup.refresh_rollup(sales.where("mes <> 2"), path, 202402, 202403)
    assert sorted(r.mes for r in rollup.stored_rollup(spark, path).read().collect()) == [1, 3]


@pytest.mark.parametrize("newest", [True, False])
def test_pages_by_key_cover_all_rows(spark, newest):
    df = spark.createDataFrame([(i // 3, i) for i in range(20)], "day int, id long")
    seen, last = [], None
    while page := page_after(df, ["day", "id"], last, 6, newest).collect():
        seen += [tuple(r) for r in page]
        last = seen[-1]
    assert seen == sorted(((i // 3, i) for i in range(20)), reverse=newest)


def test_jobs_build_on_the_declared_schemas(spark):
    empty = {name: spark.createDataFrame([], ddl) for name, ddl in SCHEMAS.items()}
    ops = empty["actividad"], empty["user"], empty["cuadrilla"]
    reps = workday.rep_kpis(*ops)
    geo = geofence.enriched_visits(empty["actividad"], empty["punto_venta"], empty["cuadrilla"])
    built = [
        reps, workday.team_kpis(reps), workday.ops_summary(reps), workday.rep_status(reps), workday.itinerary(*ops),
        workday.absences_in_period(empty["jornada_diaria"]), geofence.visit_distances(geo, empty["user"]),
        managerial.managerial_report(empty["ejecucion"], empty["cadena"], empty["punto_venta"]),
        managerial.managerial_report(empty["ejecucion"], empty["cadena"], empty["punto_venta"], "cadena"),
        shelf.store_brand_report(empty["reporte_marca_pdv"]), shelf.execution_by_rep(empty["ejecucion"]),
        shelf.risk_products(empty["agotados_con_producto"], empty["reporte_marca_pdv"]),
        shelf.stockout_rate_by_brand(empty["agotados"]), zero_sales.zero_sales_sections(empty["venta_cero"]),
        prices.price_listing(empty["precios"]), sellout.sellout_kpis(empty["detalle_sell_out"]),
        rollup.monthly_rollup(empty["detalle_sell_out"]), inventory.inventory_kpis(empty["detalle_inventario"]),
    ]
    assert all(df.columns for df in built)


def test_dump_values_go_by_name_and_escapes_are_undone(spark, tmp_path):
    text = (
        "CREATE TABLE `t` (\r\n  `id` int,\r\n  `x` text,\r\n  PRIMARY KEY (`id`)\r\n);\r\n"
        "INSERT INTO `t` (`x`, `id`) VALUES ('a\\nb\\t\\\"c\\\" \\\\n \\0 it''s',1),('z',2);\r\n"
        "INSERT INTO `t` VALUES (3,NULL);\r\nINSERT INTO `u` VALUES (9,'other');\r\n"
    )
    path = tmp_path / "dump.sql"
    path.write_bytes(text.replace("it''s", "it\\'s").encode())
    assert dump.line_end(spark, str(path)) == "\r\n"
    routed = dump.route(dump.read_statements(spark, str(path)))
    assert dump.table_columns(routed, "t") == ["id", "x"]
    loaded = dump.load_rows(routed, "t", "x string, id int, missing string", ["id", "x"])
    assert sorted(map(tuple, loaded.collect()), key=str) == [("a\nb\t\"c\" \\n \0 it's", 1, None), ("z", 2, None), (None, 3, None)]
    assert dump.merged_statements(routed).first().varias == 0
    wrong = dump.route(dump.read_statements(spark, str(path), newline="\n"))
    assert dump.merged_statements(wrong).first().varias == 1


def test_csv_goes_by_name(spark, tmp_path):
    (tmp_path / "v.csv").write_text('b,a\n"two\nlines",1\nx,2\nshort\n')
    got = views.read_csv(spark, str(tmp_path / "v.csv"), ["a", "b", "c"], multi_line=True)
    assert sorted(map(tuple, got.select("a", "b", "c").collect()), key=str) == [("1", "two\nlines", None), ("2", "x", None), (None, "short", None)]
    assert tuple(views.corrupt_rows(got).first()) == (3, 1)


def test_shared_folder_must_be_named_on_a_cluster(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
    conf = SimpleNamespace(get=lambda key, default: default)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)), "x")


def test_shuffle_width_grows_with_the_input():
    assert shuffle_width(10**9) == 200 and shuffle_width(100 * 10**12) > 300_000


@pytest.mark.parametrize("name", ["sellout_kpis", "price_kpis", "zero_sales_kpis", "inventory_kpis"])
def test_kpis_expand_collapsed_rows_only(spark, sf_dir, name):
    """Distinct counts copy rows; what they copy is already collapsed by a partial aggregation."""
    text = plan(QUERIES[name](spark, sf_dir))
    below = text[text.index("Expand") :] if "Expand" in text else text
    assert below.count("HashAggregate") >= 2


def test_fact_scans(spark, sf_dir):
    scans = lambda df, table: len(re.findall(rf"FileScan parquet [^\n]*{table}.parquet", plan(df)))
    users = spark.createDataFrame([], SCHEMAS["user"])
    teams = a.teams(spark, sf_dir)
    assert scans(workday.itinerary(a.visits(spark, sf_dir), users, teams, 6), "events") <= 2
    empty_report = spark.createDataFrame([], SCHEMAS["reporte_marca_pdv"])
    assert scans(shelf.risk_products(a.risk(spark, sf_dir), empty_report), "lineitem") == 1
