"""Every job bound to the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.functions import text
from vitrina.functions.clock import clock_text, date_text, first_of_month
from vitrina.functions.labels import (
    END_LEVELS,
    PLANOGRAM_LEVELS,
    START_LEVELS,
    STOCKOUT_LEVELS,
    level,
    workday_event,
)
from vitrina.functions.numbers import amount, total
from vitrina.operators.filters import between_days, between_months
from vitrina.operators.indexes import PageIndex
from vitrina.operators.reshape import for_display
from vitrina.plans import (
    catalog,
    cleaning,
    geofence,
    inventory,
    managerial,
    prices,
    rollup,
    sellout,
    shelf,
    workday,
    zero_sales,
)
from vitrina.session import shared_dir
from vitrina.sources import dump, export, profile, views
from vitrina.sources.daily import daily_table
from vitrina.sources.tables import read_parquet, write_parquet
from vitrina.workload import adapters as a

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _on(adapter: Query, job: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(adapter(spark, sf_dir))


# --- sources ------------------------------------------------------------------------------------


@query
def scan_by_name(spark, sf_dir):
    return read_parquet(spark, f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderdate", date_text("o_orderdate").alias("fecha_texto")
    )


@query
def roundtrip_parquet(spark, sf_dir):
    path = shared_dir(spark, "roundtrip")
    orders = a.table(spark, sf_dir, "orders")
    write_parquet(orders, path, ("o_orderstatus",))
    return spark.read.parquet(path).select(*orders.columns)


@query
def dump_route_tables(spark, sf_dir):
    routed = dump.route(a.dump(spark, sf_dir), ["part", "nation"])
    return routed.groupBy("tabla").agg(F.count(F.lit(1)).alias("sentencias"))


PART_ROWS = "id BIGINT, nombre STRING, marca STRING, activo BOOLEAN, precio DECIMAL(18,2)"


@query
def dump_load_rows(spark, sf_dir):
    routed = dump.route(a.dump(spark, sf_dir))
    return dump.load_rows(routed, "part", PART_ROWS).withColumn("precio", F.col("precio").cast("double"))


@query
def dump_rejected_rows(spark, sf_dir):
    return dump.rejected_rows(dump.route(a.dump(spark, sf_dir)), "part", 5)


@query
def profile_nulls(spark, sf_dir):
    return profile.null_profile(a.alerts(spark, sf_dir))


@query
def profile_period(spark, sf_dir):
    return profile.table_profile(a.alerts(spark, sf_dir), "fecha")


@query
def profile_top_chain(spark, sf_dir):
    return profile.value_counts(_geo(spark, sf_dir), "cadena", 15)


@query
def profile_state_visits(spark, sf_dir):
    return profile.value_counts(_geo(spark, sf_dir), "estado")


@query
def profile_broken_encoding(spark, sf_dir):
    return profile.broken_values(a.stores(spark, sf_dir), "municipio_str")


@query
def repaired_text(spark, sf_dir):
    d = a.broken_documents(spark, sf_dir)
    return d.select("doc_id", "lang", text.repair_text("texto").alias("texto"))


# --- field operations ---------------------------------------------------------------------------


def _users(spark, sf_dir):
    return a.repeated(a.users(spark, sf_dir))


def _stores(spark, sf_dir):
    return a.repeated(a.stores(spark, sf_dir))


def _ops(spark, sf_dir):
    return a.visits(spark, sf_dir), _users(spark, sf_dir), a.teams(spark, sf_dir)


def _reps(spark, sf_dir):
    return workday.rep_kpis(*_ops(spark, sf_dir), busy_limit=a.BUSY_LIMIT)


@query
def excluded_users(spark, sf_dir):
    return workday.excluded_users(a.visits(spark, sf_dir), _users(spark, sf_dir), a.BUSY_LIMIT)


@query
def clean_visits(spark, sf_dir):
    return workday.clean_visits(*_ops(spark, sf_dir), a.BUSY_LIMIT)


@query
def rep_day_facts(spark, sf_dir):
    return workday.rep_day_facts(*_ops(spark, sf_dir), a.BUSY_LIMIT)


@query
def rep_kpis(spark, sf_dir):
    return workday.in_report_order(_reps(spark, sf_dir))


@query
def absences_period(spark, sf_dir):
    days = between_days(a.workdays(spark, sf_dir), "fecha", "2024-01-01", "2024-01-31")
    return workday.absences_in_period(days)


@query
def ops_summary(spark, sf_dir):
    return workday.ops_summary(_reps(spark, sf_dir))


@query
def team_kpis(spark, sf_dir):
    return workday.team_kpis(_reps(spark, sf_dir)).withColumns(
        {
            "nivel_inicio": level("pct_inicio", START_LEVELS),
            "nivel_fin": level("pct_fin", END_LEVELS),
        }
    )


@query
def rep_status(spark, sf_dir):
    return workday.rep_status(_reps(spark, sf_dir))


@query
def daily_trend(spark, sf_dir):
    return workday.daily_trend(a.visits(spark, sf_dir), _users(spark, sf_dir), a.BUSY_LIMIT)


@query
def itinerary(spark, sf_dir):
    return workday.itinerary(*_ops(spark, sf_dir), a.BUSY_LIMIT)


@query
def itinerary_totals(spark, sf_dir):
    return workday.itinerary_totals(workday.itinerary(*_ops(spark, sf_dir), a.BUSY_LIMIT))


@query
def last_activity_day(spark, sf_dir):
    return workday.last_activity_day(a.visits(spark, sf_dir))


# --- geofence -----------------------------------------------------------------------------------


def _geo(spark, sf_dir):
    return geofence.enriched_visits(
        a.visits(spark, sf_dir), _stores(spark, sf_dir), a.teams(spark, sf_dir), [0, 1, 2, 3]
    )


def _geo_visits(spark, sf_dir):
    return geofence.classified(geofence.visit_distances(_geo(spark, sf_dir), _users(spark, sf_dir)))


@query
def geo_enriched_visits(spark, sf_dir):
    return _geo(spark, sf_dir).withColumn("lon_pdv", F.nanvl("lon_pdv", F.lit(None)))


@query
def geo_visits(spark, sf_dir):
    return (
        _geo_visits(spark, sf_dir)
        .withColumn("lon_pdv", F.nanvl("lon_pdv", F.lit(None)))
        .drop("hora_checkin")
    )


def _former_visits(visits):
    """The visits before the last day came in, with one day's marks and one day's hours still wrong."""
    last, first = (
        visits.agg(F.max("fecha_planeada").alias("ultimo"), F.min("fecha_planeada").alias("primero")).first()
    )
    day, hour = F.col("fecha_planeada"), F.expr("INTERVAL 1 HOUR")
    return visits.where(day.isNull() | (day < F.lit(last))).withColumns(
        {
            "is_no_planeada": F.when(day == F.lit(first), ~F.col("is_no_planeada")).otherwise(F.col("is_no_planeada")),
            "fecha_real_final": F.when(day == F.date_add(F.lit(first), 1), F.col("fecha_real_final") + hour).otherwise(
                F.col("fecha_real_final")
            ),
        }
    )


@query
def geo_refreshed(spark, sf_dir):
    """Enriched visits kept by day, brought up to date after a new day, a corrected day and a renamed store."""
    visits, stores, teams = a.visits(spark, sf_dir), _stores(spark, sf_dir), a.teams(spark, sf_dir)
    path, clients = shared_dir(spark, "geo"), [0, 1, 2, 3]
    former = stores.withColumn("sucursal", F.when(F.col("id") != 1, F.col("sucursal")).otherwise("Suc antigua"))
    geofence.refresh_enriched(_former_visits(visits), former, teams, path, clients)
    geofence.refresh_enriched(visits, stores, teams, path, clients)
    stored = daily_table(spark, path).read()
    return stored.withColumn("lon_pdv", F.nanvl("lon_pdv", F.lit(None)))


@query
def rep_day_facts_refreshed(spark, sf_dir):
    """Rep-day facts from the collapsed visits kept by day, after a new day and corrected days."""
    visits, users, teams = _ops(spark, sf_dir)
    path = shared_dir(spark, "rep-days")
    workday.refresh_rep_days(_former_visits(visits), path)
    workday.refresh_rep_days(visits, path)
    return workday.rep_day_facts(daily_table(spark, path).read(), users, teams, a.BUSY_LIMIT, collapsed=True)


QUERIES["geo_period"] = _on(_geo, geofence.geo_period)
QUERIES["geo_options_state"] = _on(_geo, geofence.state_options)
QUERIES["geo_options_municipality"] = _on(
    _geo, lambda geo: geofence.municipality_options(geo, estado="Ciudad de México")
)
QUERIES["geo_options_chain"] = _on(_geo, lambda geo: geofence.chain_options(geo, estado="Nuevo León"))
QUERIES["geo_options_route"] = _on(
    _geo, lambda geo: geofence.route_options(geo, start="2024-01-01", end="2024-01-30", estado="Todos")
)
QUERIES["geo_kpis"] = _on(_geo_visits, geofence.geo_kpis)
QUERIES["geo_center"] = _on(_geo_visits, geofence.map_center)
QUERIES["geo_by_rep"] = _on(_geo_visits, geofence.anomalies_by_rep)
QUERIES["geo_by_route"] = _on(_geo_visits, geofence.anomalies_by_route)
QUERIES["geo_critical"] = _on(_geo_visits, geofence.critical_list)
QUERIES["geo_detail"] = _on(_geo_visits, geofence.visit_detail)
QUERIES["geo_detail_anomalies"] = _on(_geo_visits, lambda v: geofence.visit_detail(v, True))


# --- shelf execution ----------------------------------------------------------------------------

QUERIES["shelf_kpis"] = _on(a.brand_report, shelf.shelf_kpis)
QUERIES["visits_by_brand"] = _on(a.brand_report, shelf.visits_by_brand)
QUERIES["planogram_by_brand"] = _on(
    a.brand_report,
    lambda r: shelf.planogram_by_brand(r).withColumn("nivel", level("pct_planograma", PLANOGRAM_LEVELS)),
)
QUERIES["top_stores_visits"] = _on(a.brand_report, shelf.top_stores_visits)
QUERIES["stockouts_by_brand"] = _on(
    a.brand_report,
    lambda r: shelf.stockouts_by_brand(r).withColumn(
        "nivel", level("pct_agotados", STOCKOUT_LEVELS, higher_is_better=False)
    ),
)
QUERIES["stockouts_by_brand_long"] = _on(a.brand_report, shelf.stockouts_by_brand_long)
QUERIES["top_stores_stockouts"] = _on(a.brand_report, shelf.top_stores_stockouts)
QUERIES["execution_summary"] = _on(a.brand_report, shelf.execution_summary)
QUERIES["execution_detail_pct"] = _on(
    a.brand_report, lambda r: shelf.execution_detail(shelf.execution_summary(r, None))
)
QUERIES["brand_options"] = _on(a.brand_report, shelf.brand_options)
QUERIES["chain_options"] = _on(a.brand_report, shelf.chain_options)
QUERIES["store_brand_report"] = _on(
    a.brand_report, lambda r: shelf.in_report_order(shelf.store_brand_report(r))
)
QUERIES["store_brand_totals"] = _on(
    a.brand_report, lambda r: shelf.store_brand_totals(shelf.store_brand_report(r))
)
QUERIES["execution_by_rep"] = _on(a.executions, shelf.execution_by_rep)
QUERIES["execution_by_chain"] = _on(a.executions, shelf.execution_by_chain)
QUERIES["stockout_rate_by_brand"] = _on(a.stockouts, shelf.stockout_rate_by_brand)
QUERIES["top_stores_stockout_rate"] = _on(a.stockouts, shelf.top_stores_stockout_rate)


@query
def risk_products(spark, sf_dir):
    return shelf.risk_products(a.risk(spark, sf_dir), a.brand_report(spark, sf_dir))


@query
def store_brand_report_risk(spark, sf_dir):
    report = shelf.store_brand_report(a.brand_report(spark, sf_dir))
    products = shelf.risk_products(a.risk(spark, sf_dir), report)
    return shelf.with_risk_products(report, products).select(
        "cadena", "pdv_id", "marca", "agotados", "agotados_mas", "preagotados", "preagotados_mas"
    )


def _managerial(by: str) -> Query:
    return lambda spark, sf_dir: managerial.managerial_report(
        a.executions(spark, sf_dir),
        a.repeated(a.chain_names(spark, sf_dir)),
        a.repeated(a.store_names(spark, sf_dir)),
        by,
    )


@query
def store_brand_levels(spark, sf_dir):
    built = shelf.with_levels(shelf.store_brand_report(a.brand_report(spark, sf_dir)))
    return built.select("cadena", "pdv_id", "marca", *[c for c in built.columns if c.startswith("nivel_")])


@query
def managerial_levels(spark, sf_dir):
    built = managerial.with_levels(_managerial("pdv")(spark, sf_dir))
    return built.select("nombre_cadena", "nombre_pdv", "nivel_cumplimiento", "nivel_agotados")


QUERIES["managerial_by_store"] = _managerial("pdv")
QUERIES["managerial_by_chain"] = _managerial("cadena")
QUERIES["managerial_totals"] = _on(a.executions, managerial.managerial_totals)


# --- zero sales and prices ----------------------------------------------------------------------

QUERIES["zero_sales_kpis"] = _on(a.alerts, zero_sales.zero_sales_kpis)
QUERIES["zero_sales_by_brand"] = _on(a.alerts, zero_sales.zero_sales_by_brand)
QUERIES["zero_sales_status"] = _on(a.alerts, zero_sales.zero_sales_status)
QUERIES["zero_sales_totals"] = _on(a.alerts, zero_sales.zero_sales_totals)
QUERIES["zero_sales_sections"] = _on(
    a.alerts, lambda df: zero_sales.zero_sales_sections(df, ["Brand#3", "Brand#1", "OTRA"])
)
QUERIES["zero_sales_listing"] = _on(
    a.alerts,
    lambda df: zero_sales.zero_sales_listing(df).withColumn("inventario", F.col("inventario").cast("double")),
)
QUERIES["price_kpis"] = _on(a.prices, prices.price_kpis)
QUERIES["price_by_type"] = _on(a.prices, prices.price_by_type)
QUERIES["price_by_category"] = _on(a.prices, prices.price_by_category)
QUERIES["price_distribution"] = _on(a.prices, prices.price_distribution)
QUERIES["price_listing"] = _on(
    a.prices,
    lambda df: prices.price_listing(prices.active_prices(df, product="RING", kind="propio")).withColumn(
        "precio", F.col("precio").cast("double")
    ),
)
QUERIES["price_listing_counts"] = _on(
    a.prices, lambda df: prices.price_listing_counts(prices.active_prices(df))
)


# --- sell-out, roll-up, inventory, catalogue ----------------------------------------------------

QUERIES["sellout_kpis"] = _on(a.sales, sellout.sellout_kpis)
QUERIES["sales_by_region"] = _on(a.sales, sellout.sales_by_region)
QUERIES["sales_by_channel"] = _on(a.sales, sellout.sales_by_channel)
QUERIES["top_products_sales"] = _on(a.sales, sellout.top_products_sales)
QUERIES["top_stores_sales"] = _on(a.sales, sellout.top_stores_sales)
QUERIES["sales_monthly_trend"] = _on(a.sales, sellout.sales_monthly_trend)
QUERIES["last_period"] = _on(a.sales, sellout.last_period)


def _rollup(spark, sf_dir):
    return rollup.monthly_rollup(a.sales(spark, sf_dir))


QUERIES["monthly_rollup"] = _on(
    a.sales, lambda s: rollup.monthly_rollup(s).drop("tiendas").withColumn("monto", F.col("monto").cast("double"))
)


def _stored_rollup(spark, sf_dir):
    """The roll-up as the reports get it: written by a refresh and read back."""
    path = shared_dir(spark, "rollup")
    rollup.refresh_rollup(a.sales(spark, sf_dir), path)
    return rollup.stored_rollup(spark, path).read()


QUERIES["rollup_kpis"] = _on(_stored_rollup, lambda r: rollup.rollup_kpis(r, exact=True))
QUERIES["rollup_trend"] = _on(_stored_rollup, lambda r: rollup.rollup_trend(r, exact=True))
QUERIES["rollup_yoy_month"] = _on(_rollup, lambda r: rollup.same_month_by_year(r, 5))


@query
def rollup_kpis_channel(spark, sf_dir):
    channel = rollup.of_channel(_rollup(spark, sf_dir), a.channels(spark, sf_dir), "BUILDING")
    return rollup.rollup_kpis(channel)


@query
def rollup_top_products(spark, sf_dir):
    return rollup.top_products(
        _stored_rollup(spark, sf_dir), a.repeated(a.products(spark, sf_dir)), exact=True
    )


@query
def rollup_top_chains(spark, sf_dir):
    return rollup.top_chains(
        _stored_rollup(spark, sf_dir), a.repeated(a.chains(spark, sf_dir)), exact=True
    )


@query
def rollup_channel_mix(spark, sf_dir):
    return rollup.channel_mix(_rollup(spark, sf_dir), a.repeated(a.channels(spark, sf_dir)))


@query
def channel_options(spark, sf_dir):
    named = a.repeated(a.channels(spark, sf_dir)).where(F.col("nombre").isNotNull())
    return rollup.channel_options(_rollup(spark, sf_dir), named)


QUERIES["inventory_kpis"] = _on(a.inventory, inventory.inventory_kpis)
QUERIES["inventory_by_region"] = _on(a.inventory, inventory.inventory_by_region)
QUERIES["overstock_products"] = _on(a.inventory, inventory.overstock_products)
QUERIES["stock_vs_sales"] = _on(a.inventory, inventory.stock_vs_sales)
QUERIES["inventory_monthly_trend"] = _on(a.inventory, inventory.inventory_monthly_trend)
QUERIES["catalog_summary"] = _on(a.products, catalog.catalog_summary)
QUERIES["products_by_brand"] = _on(a.products, catalog.products_by_brand)


# --- catalogue search ---------------------------------------------------------------------------


def _found_reps(spark, sf_dir):
    return catalog.matching(a.users(spark, sf_dir), catalog.CATALOGS["promotores"], q="rep 1")


QUERIES["catalog_search_page"] = _on(
    _found_reps, lambda df: catalog.search_page(df, catalog.CATALOGS["promotores"], 2, 3)
)
QUERIES["catalog_search_count"] = _on(_found_reps, lambda df: catalog.search_counts(df, 2, 3))
QUERIES["record_by_id"] = _on(a.users, lambda df: catalog.record_by_id(df, 7))


@query
def catalog_search_teams(spark, sf_dir):
    found = catalog.matching(
        a.teams(spark, sf_dir), catalog.CATALOGS["cuadrillas"], q="r1", entidad="nation_"
    )
    return catalog.search_page(found, catalog.CATALOGS["cuadrillas"])


@query
def catalog_search_workdays(spark, sf_dir):
    found = catalog.matching(
        a.workdays(spark, sf_dir), catalog.CATALOGS["jornadas"], q="FALTA", end="2024-01-30"
    )
    return _workday_page(found, catalog.CATALOGS["jornadas"])


def _workday_page(found, spec):
    return catalog.search_page(found, spec).select(
        "id",
        "usuario_id",
        "fecha",
        clock_text("fecha").alias("hora"),
        first_of_month("fecha").alias("mes_desde"),
        "incidencia",
        workday_event().alias("tipo"),
    )


def _search(adapter: Query, name: str, **wanted) -> Query:
    """Newest page of one catalogue, the largest id first."""

    def found(spark, sf_dir):
        rows = catalog.matching(adapter(spark, sf_dir), catalog.CATALOGS[name], **wanted)
        return catalog.search_after(rows, catalog.CATALOGS[name])

    return found


QUERIES["catalog_search_brand_execution"] = _search(
    a.brand_executions, "ejecucion_marca", q="p1", nombre_marca="brand#1"
)
QUERIES["catalog_search_store_execution"] = _search(a.store_executions, "ejecucion_pdv", q="falta")
QUERIES["catalog_search_brand_audit"] = _search(a.brand_executions, "auditoria_marca", supervisor="sup 3")
QUERIES["catalog_search_competition"] = _search(a.competition, "competencia", q="2x1", marca="brand#2")
QUERIES["catalog_search_prices"] = _search(a.raw_prices, "precios", q="sup 1")
QUERIES["catalog_search_absences"] = _search(a.absence_types, "ausencias", q="nation_1")
QUERIES["catalog_search_services"] = _search(a.services, "servicios", q="promo")


@query
def catalog_search_after(spark, sf_dir):
    """The page behind a given row, without sorting what lies before it."""
    found = catalog.matching(a.users(spark, sf_dir), catalog.CATALOGS["promotores"], q="rep 1")
    return catalog.search_after(found, catalog.CATALOGS["promotores"], last=(15,), size=3)


def _indexed(adapter: Query, name: str, finish=catalog.search_after, **wanted) -> Query:
    """The same search through a trigram index of the catalogue."""

    def found(spark, sf_dir):
        index = catalog.build_index(adapter(spark, sf_dir), catalog.CATALOGS[name], shared_dir(spark, "index"))
        return finish(catalog.indexed_matching(index, catalog.CATALOGS[name], **wanted), catalog.CATALOGS[name])

    return found


QUERIES["indexed_search_brand_execution"] = _indexed(
    a.brand_executions, "ejecucion_marca", q="p1", nombre_marca="brand#1"
)
QUERIES["indexed_search_store_execution"] = _indexed(a.store_executions, "ejecucion_pdv", q="falta")
QUERIES["indexed_search_brand_audit"] = _indexed(a.brand_executions, "auditoria_marca", supervisor="sup 3")
QUERIES["indexed_search_competition"] = _indexed(a.competition, "competencia", q="2x1", marca="brand#2")
QUERIES["indexed_search_prices"] = _indexed(a.raw_prices, "precios", q="sup 1")
QUERIES["indexed_search_absences"] = _indexed(a.absence_types, "ausencias", q="nation_1")
QUERIES["indexed_search_services"] = _indexed(a.services, "servicios", q="promo")
QUERIES["indexed_search_teams"] = _indexed(a.teams, "cuadrillas", catalog.search_page, q="r1", entidad="nation_")
QUERIES["indexed_search_page"] = _indexed(a.users, "promotores", lambda df, c: catalog.search_page(df, c, 2, 3), q="rep 1")
QUERIES["indexed_search_workdays"] = _indexed(
    a.workdays, "jornadas", _workday_page, q="FALTA", end="2024-01-30"
)


@query
def page_by_number(spark, sf_dir):
    """Page 100 of the newest orders, from the range that holds it."""
    orders = read_parquet(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    return PageIndex.build(orders, ["o_orderkey"], shared_dir(spark, "pages"), rows=1_000).page(100, 50)


# --- stored tables ------------------------------------------------------------------------------


def _last_month(df):
    """The last month with rows, as months since year 0."""
    return df.agg(F.max(F.col("anio") * 12 + F.col("mes") - 1)).first()[0]


def _yyyymm(month):
    return month // 12 * 100 + month % 12 + 1


@query
def rollup_range(spark, sf_dir):
    """The last three months of a stored roll-up."""
    stored = _stored_rollup(spark, sf_dir)
    last = _last_month(stored)
    picked = between_months(stored, _yyyymm(last - 2), _yyyymm(last))
    return picked.groupBy("anio", "mes").agg(amount("monto").alias("monto"), F.count(F.lit(1)).alias("filas"))


@query
def rollup_refreshed(spark, sf_dir):
    """A stored roll-up after the sales of its last month but one were withdrawn, those of the last
    doubled, and the last three months refreshed."""
    path, sales = shared_dir(spark, "rollup"), a.sales(spark, sf_dir)
    rollup.refresh_rollup(sales, path)
    table = rollup.stored_rollup(spark, path)
    last = _last_month(table.read())
    month = F.col("anio") * 12 + F.col("mes") - 1
    changed = sales.where(month != last - 1).withColumn(
        "piezas", F.when(month == last, F.col("piezas") * 2).otherwise(F.col("piezas"))
    )
    rollup.refresh_rollup(changed, path, _yyyymm(last - 2), _yyyymm(last))
    return table.read().groupBy("anio", "mes").agg(
        amount("monto").alias("monto"), total("piezas").alias("piezas"), F.count(F.lit(1)).alias("filas")
    )


@query
def itinerary_display(spark, sf_dir):
    """The itinerary under its display names."""
    return for_display(workday.itinerary(*_ops(spark, sf_dir), a.BUSY_LIMIT), workday.ITINERARY_LABELS)


@query
def report_bundle(spark, sf_dir):
    """The written rep report and two reports built from it, read back and counted."""
    path = shared_dir(spark, "report")
    jobs = {"equipos": workday.team_kpis, "resumen": workday.ops_summary}
    export.write_ops_report(_reps(spark, sf_dir), jobs, path)
    parts = [
        spark.read.parquet(f"{path}/{name}").agg(
            F.lit(name).alias("informe"), F.count(F.lit(1)).alias("filas"), total(column).alias("plan")
        )
        for name, column in (("promotores", "plan"), ("equipos", "plan"), ("resumen", "plan"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def products_at_risk(spark, sf_dir):
    """Every product at risk, which the report lists show four of."""
    return shelf.products_at_risk(a.risk(spark, sf_dir))


@query
def dump_file_rows(spark, sf_dir):
    """A dump file with CREATE TABLE, Windows line ends and a column list, written and read back."""
    path = shared_dir(spark, "dump")
    a.dump_file(spark, sf_dir).write.option("lineSep", ";\r\n").text(path)
    routed = dump.route(dump.read_statements(spark, path))
    return dump.load_rows(routed, "supplier", "id BIGINT, nombre STRING, nota STRING", dump.table_columns(routed, "supplier"))


@query
def dump_file_merged(spark, sf_dir):
    """The same file read with the wrong line end: its records hold many statements."""
    path = shared_dir(spark, "dump")
    a.dump_file(spark, sf_dir).write.option("lineSep", ";\r\n").text(path)
    wrong, right = dump.read_statements(spark, path, newline="\n"), dump.read_statements(spark, path)
    counts = [
        dump.merged_statements(dump.route(read)).select(F.lit(name).alias("lectura"), (F.col("varias") > 0).alias("varias"))
        for name, read in (("otro fin de linea", wrong), ("su fin de linea", right))
    ]
    return counts[0].union(counts[1])


@query
def dump_tuple_rows(spark, sf_dir):
    """The dump of ``dump_load_rows`` in large statements, read tuple by tuple."""
    path = shared_dir(spark, "dump")
    a.dump(spark, sf_dir, per_statement=5_000).write.option("lineSep", ";\r\n").text(path)
    tuples = dump.read_tuples(spark, path)
    return dump.load_tuples(tuples, "part", "id BIGINT, nombre STRING, marca STRING, activo BOOLEAN, precio DOUBLE")


@query
def dump_tuple_tables(spark, sf_dir):
    """Tuples per table of the same dump, with the columns its CREATE TABLE or INSERT names."""
    path = shared_dir(spark, "dump")
    a.dump_file(spark, sf_dir).write.option("lineSep", ";\r\n").text(path)
    found = dump.read_tuples(spark, path)
    return found.groupBy("tipo", "tabla", F.array_join("columnas", ",").alias("columnas")).agg(F.count(F.lit(1)).alias("filas"))


@query
def ingest_csv(spark, sf_dir):
    """CSV with its columns in another order and line breaks inside quotes."""
    path = shared_dir(spark, "csv")
    views.write_csv(a.csv_view(spark, sf_dir).select("nota", "nombre", "id"), path)
    return views.read_csv(spark, path, ["id", "nombre", "nota", "ausente"], multi_line=True).drop(views.CORRUPT)


@query
def ingest_csv_corrupt(spark, sf_dir):
    """CSV lines of which some lack a field."""
    path = shared_dir(spark, "csv")
    a.csv_lines(spark, sf_dir).write.text(path)
    return views.corrupt_rows(views.read_csv(spark, path, ["id", "nombre"]))


# --- cleaning -----------------------------------------------------------------------------------


def _cleaned(job: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, sf_dir: job(a.dirty_lines(spark, sf_dir)).select("clave", *columns)


QUERIES["clean_operations"] = _cleaned(
    cleaning.clean_operations,
    "fecha",
    "inicio_jornada",
    "fin_jornada",
    "anio",
    "mes",
    "semana",
    "dia_semana",
    "horas_laboradas",
    "pct_cumplimiento_plan",
    "pct_cumplimiento_visitas",
    "cumple_plan",
    "entidad",
)
QUERIES["clean_execution"] = _cleaned(
    cleaning.clean_execution,
    "fecha",
    "con_agotados",
    "planograma",
    "status",
    "anio",
    "mes",
    "semana",
    "pct_sku_agotados",
    "nombre_marca",
    "cadena",
)
QUERIES["clean_stockouts"] = _cleaned(
    cleaning.clean_stockouts, "anio", "mes", "marca", "cadena", "nivel_quiebre"
)
QUERIES["clean_risk_products"] = _cleaned(
    cleaning.clean_risk_products, "fecha", "marca", "cadena", "producto_en_riesgo"
)
QUERIES["clean_zero_sales"] = _cleaned(
    cleaning.clean_zero_sales,
    "fecha",
    "ejecutada",
    "anio",
    "mes",
    "inventario",
    "marca",
    "cadena",
    "promotor",
)
QUERIES["clean_prices"] = _cleaned(
    cleaning.clean_prices,
    "fecha",
    "is_propio",
    "status",
    "anio",
    "mes",
    "precio",
    "tipo_precio",
    "categoria",
    "cadena",
    "promotor",
)
QUERIES["clean_brand_report"] = _cleaned(
    cleaning.clean_brand_report,
    "fecha",
    "anio",
    "mes",
    "semana",
    "pct_planograma",
    "pct_visitas_agotados",
    "nivel_planograma",
    "cadena",
    "marca",
)
