import pytest
from pyspark.sql import functions as F

from vitrina.plans import managerial, prices, shelf, zero_sales


@pytest.fixture(scope="module")
def report(spark):
    return spark.createDataFrame(
        [
            (1, "PDV A", "Walmart", "CDMX", "MarcaX", 10, 100, 8, 5, 3),
            (2, "PDV B", "Oxxo", "MTY", "MarcaY", 5, 50, 3, 2, 1),
            (1, "PDV A", "Walmart", "CDMX", "MarcaX", 8, 80, 6, 3, 2),
            (3, "PDV C", "7Eleven", "GDL", "MarcaY", 3, 30, 2, 1, 0),
        ],
        "pdv_id BIGINT, punto_venta STRING, cadena STRING, estado STRING, marca STRING, total_visitas INT,"
        " cant_sku INT, cumple_planograma INT, cant_sku_agotados INT, cant_sku_preagotados INT",
    ).withColumns(
        {"municipio": F.lit("M"), "visitas_con_agotados": F.lit(1), "visitas_con_preagotados": F.lit(0)}
    )


@pytest.fixture(scope="module")
def alerts(spark):
    return spark.createDataFrame(
        [
            ("MarcaX", "Prod1", "PDV A", 1, 1),
            ("MarcaX", "Prod2", "PDV B", 2, 0),
            ("MarcaY", "Prod3", "PDV A", 1, 1),
            ("MarcaY", "Prod4", "PDV C", 3, 0),
        ],
        "marca STRING, producto STRING, punto_venta STRING, punto_venta_id BIGINT, ejecutada INT",
    ).withColumn("inventario", F.lit(2).cast("decimal(19,2)"))


@pytest.fixture(scope="module")
def observed(spark):
    return spark.createDataFrame(
        [
            ("Prod1", "Cat A", "Walmart", 10.0, 1),
            ("Prod2", "Cat A", "Oxxo", 12.0, 1),
            ("Prod3", "Cat B", "Walmart", 8.0, 0),
            ("Prod4", "Cat B", "Oxxo", 9.0, 0),
        ],
        "producto STRING, categoria STRING, cadena STRING, precio DOUBLE, is_propio INT",
    )


def test_shelf_kpis(report):
    assert shelf.shelf_kpis(report).first().asDict() == {
        "pdvs_unicos": 3,
        "total_visitas": 26,
        "total_sku": 260,
        "total_agotados": 11,
        "total_preagotados": 6,
        "pct_planograma": 73.1,
        "pct_agotados": 4.2,
        "pct_preagotados": 2.3,
    }


def test_shelf_kpis_of_nothing(report):
    row = shelf.shelf_kpis(report.where(F.lit(False))).first()
    assert (row.total_visitas, row.pct_planograma, row.pct_agotados, row.pct_preagotados) == (0, 0, 0, 0)


def test_visits_by_brand(report, rows):
    assert rows(shelf.visits_by_brand(report)) == [("MarcaY", 8), ("MarcaX", 18)]


def test_planogram_by_brand(report, rows):
    assert rows(shelf.planogram_by_brand(report)) == [("MarcaX", 14, 18, 77.8), ("MarcaY", 5, 8, 62.5)]


def test_top_stores(report, rows):
    assert rows(shelf.top_stores_visits(report), "punto_venta", "total_visitas") == [
        ("PDV A", 18),
        ("PDV B", 5),
        ("PDV C", 3),
    ]
    assert len(rows(shelf.top_stores_visits(report, 1))) == 1
    assert rows(shelf.top_stores_stockouts(report)) == [("PDV A", 8), ("PDV B", 2), ("PDV C", 1)]


def test_stockouts_by_brand_rounds_ties_to_even(report, rows):
    assert rows(shelf.stockouts_by_brand(report)) == [
        ("MarcaX", 8, 5, 180, 4.4, 2.8),
        ("MarcaY", 3, 1, 80, 3.8, 1.2),
    ]


def test_stockouts_long_form(report, rows):
    assert set(rows(shelf.stockouts_by_brand_long(report))) == {
        ("MarcaX", "Agotados", 4.4),
        ("MarcaX", "Preagotados", 2.8),
        ("MarcaY", "Agotados", 3.8),
        ("MarcaY", "Preagotados", 1.2),
    }


def test_null_groups_are_dropped_from_charts_but_kept_in_reports(report, rows):
    unknown = report.withColumn("marca", F.when(F.col("marca") == "MarcaX", F.col("marca")))
    assert rows(shelf.visits_by_brand(unknown)) == [("MarcaX", 18)]
    summary = shelf.execution_summary(unknown)
    assert summary.where(F.col("marca").isNull()).count() == 2
    assert rows(shelf.store_brand_report(unknown).where("marca = ''").agg(F.sum("total_visitas"))) == [(8,)]


def test_zero_denominator_gives_null(report, rows):
    none = report.withColumn("cant_sku", F.lit(0))
    assert rows(shelf.stockouts_by_brand(none), "pct_agotados") == [(None,), (None,)]


def test_store_brand_report_and_totals(report, rows):
    built = shelf.store_brand_report(report)
    assert rows(shelf.in_report_order(built), "pdv_id", "total_visitas", "pct_planograma", "pct_sku_agotados") == [
        (3, 3, 66.7, 3.3),
        (2, 5, 60.0, 4.0),
        (1, 18, 77.8, 4.4),
    ]
    totals = shelf.store_brand_totals(built).first()
    assert (totals.total_visitas, totals.pdvs_unicos, totals.pct_agotados_gral) == (26, 3, 4.2)


def test_risk_products_lists_and_counts(spark, report):
    seen = [(1, "MarcaX", f"P{i}", 1, 0) for i in (6, 5, 4, 3, 2, 1, 1)]
    seen += [(1, "MarcaX", "Q1", None, 2), (1, "MarcaX", "Z0", 0, 0), (9, "MarcaX", "P1", 1, 1)]
    risk = spark.createDataFrame(
        seen,
        "punto_venta_id BIGINT, marca STRING, producto_en_riesgo STRING, cant_agotados INT, cant_preagotados INT",
    )
    built = shelf.store_brand_report(report)
    products = shelf.risk_products(risk, built)
    assert [r.asDict() for r in products.collect()] == [
        {
            "punto_venta_id": 1,
            "marca": "MarcaX",
            "agotados": "P1, P2, P3, P4",
            "agotados_mas": 2,
            "preagotados": "Q1",
            "preagotados_mas": 0,
        }
    ]
    joined = shelf.with_risk_products(built, products)
    assert joined.count() == 3
    assert joined.where("agotados IS NOT NULL").count() == 1


def test_zero_sales(alerts, rows):
    row = zero_sales.zero_sales_kpis(alerts).first()
    assert row.asDict() == {
        "total_registros": 4,
        "ejecutadas": 2,
        "pendientes": 2,
        "pct_ejecutado": 50.0,
        "marcas_afectadas": 2,
        "pdvs_afectados": 3,
    }
    assert rows(zero_sales.zero_sales_status(alerts)) == [(2, 2)]
    assert rows(zero_sales.zero_sales_by_brand(alerts)) == [("MarcaX", 2), ("MarcaY", 2)]


def test_unknown_execution_is_pending_only_in_the_report(alerts):
    unknown = alerts.withColumn("ejecutada", F.when(F.col("producto") != "Prod2", F.col("ejecutada")))
    assert zero_sales.zero_sales_kpis(unknown).first().pendientes == 1
    totals = zero_sales.zero_sales_totals(unknown).first()
    assert (totals.pendientes, totals.inv_total, totals.pdvs_afectados) == (2, 8.0, 3)


def test_sections_keep_unlisted_brands_last(alerts, rows):
    extra = alerts.withColumn("marca", F.when(F.col("marca") == "MarcaX", "FAGE"))
    built = zero_sales.zero_sales_sections(extra.union(alerts.where("marca = 'MarcaY'")))
    assert rows(built, "marca", "total_productos") == [("FAGE", 2), ("OTRA", 2), ("MarcaY", 2)]


def test_prices(observed, rows):
    row = prices.price_kpis(observed).first()
    assert tuple(row) == (4, 11.0, 8.5, 2, 2, 2)
    assert rows(prices.price_by_type(observed)) == [("Competencia", 8.5), ("Propio", 11.0)]
    assert rows(prices.price_by_category(observed)) == [("Cat A", "Propio", 11.0), ("Cat B", "Competencia", 8.5)]


def test_unknown_owner_counts_as_competitor(observed, rows):
    unknown = observed.withColumn("is_propio", F.when(F.col("is_propio") == 1, 1))
    assert rows(prices.price_by_type(unknown), "tipo") == [("Competencia",), ("Propio",)]
    assert prices.price_kpis(unknown).first().precio_promedio_competencia == 0.0


def test_price_distribution(observed):
    built = {r.tipo: r for r in prices.price_distribution(observed).collect()}
    own = built["Propio"]
    assert (own.minimo, own.q1, own.mediana, own.q3, own.maximo) == (10.0, 10.5, 11.0, 11.5, 12.0)


def test_active_prices_filters(observed):
    df = observed.withColumns(
        {"status": F.col("producto") != "Prod2", "fecha": F.lit("2024-03-31 18:30:00").cast("timestamp_ntz")}
    )
    assert prices.active_prices(df).count() == 3
    assert prices.active_prices(df, "2024-03-01", "2024-03-31").count() == 3
    assert prices.active_prices(df, end="2024-03-30").count() == 0
    assert prices.active_prices(df, chain="todas", product="PROD3").count() == 1
    assert prices.active_prices(df, kind="propio").count() == 1


def test_execution(spark, rows):
    execution = spark.createDataFrame(
        [
            ("Ana", 1, "Walmart", 10, 1, 0, 1),
            ("Ana", 2, "Oxxo", 8, 0, 1, 1),
            ("Bob", 3, "Walmart", 12, 2, 1, 0),
            ("Bob", 4, "7Eleven", 6, 1, 0, 1),
        ],
        "promotor STRING, punto_venta_id BIGINT, cadena STRING, cant_sku INT, cant_agotados INT,"
        " cant_preagotados INT, planograma INT",
    )
    assert rows(shelf.execution_by_rep(execution)) == [("Ana", 2, 1, 1, 18, 2), ("Bob", 2, 3, 1, 18, 1)]
    assert rows(shelf.execution_by_chain(execution)) == [
        ("Walmart", 2, 2, 3, 22),
        ("7Eleven", 1, 1, 1, 6),
        ("Oxxo", 1, 1, 0, 8),
    ]


def test_stockout_rate(spark, rows):
    stockouts = spark.createDataFrame(
        [
            ("MarcaX", "PDV A", "Walmart", "CDMX", 5, 2, 50, 10),
            ("MarcaX", "PDV B", "Oxxo", "MTY", 3, 1, 30, 6),
            ("MarcaY", "PDV A", "Walmart", "CDMX", 2, 1, 20, 4),
        ],
        "marca STRING, punto_venta STRING, cadena STRING, estado STRING, total_agotados INT,"
        " total_preagotados INT, total_sku INT, visitas INT",
    )
    assert rows(shelf.stockout_rate_by_brand(stockouts)) == [("MarcaX", 8, 80, 16, 10.0), ("MarcaY", 2, 20, 4, 10.0)]
    top = shelf.top_stores_stockout_rate(stockouts)
    assert rows(top, "punto_venta", "pct_quiebre") == [("PDV A", 10.0), ("PDV B", 10.0)]


def test_managerial(spark, rows):
    executions = spark.createDataFrame(
        [(1, 1, 10, True, "2", 10), (2, 1, 10, False, "x", 20), (3, 2, 99, True, None, 0), (4, None, 11, None, "1", 5)],
        "id BIGINT, cadena_id BIGINT, punto_venta_id BIGINT, planograma BOOLEAN, cant_agotados STRING, cant_sku INT",
    )
    chains = spark.createDataFrame([(1, "Uno")], "id BIGINT, nombre STRING")
    stores = spark.createDataFrame([(10, "T10"), (11, "T11")], "id BIGINT, nombre STRING")
    by_store = managerial.managerial_report(executions, chains, stores)
    assert rows(by_store) == [
        ("ID: None", "T11", 1, 0, 1, 5, 0.0, 20.0),
        ("Uno", "T10", 2, 1, 2, 30, 50.0, 6.67),
        ("ID: 2", "ID: 99", 1, 1, 0, 0, 100.0, 0.0),
    ]
    by_chain = managerial.managerial_report(executions, chains, stores, by="cadena")
    assert rows(by_chain, "nombre_cadena", "visitas") == [("ID: None", 1), ("Uno", 2), ("ID: 2", 1)]
    assert rows(managerial.managerial_totals(executions)) == [(4, 50.0, 8.57)]
    assert rows(managerial.managerial_totals(executions.where(F.lit(False)))) == [(0, 0.0, 0.0)]
