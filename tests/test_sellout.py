from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vitrina.operators.filters import between_months
from vitrina.plans import catalog, inventory, rollup, sellout
from vitrina.workload import adapters


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [
            (100.0, 1000.0, 10, 10.0, 1, 101, 1, "Norte", 2025, 1),
            (200.0, 2000.0, 20, 10.0, 2, 102, 1, "Sur", 2025, 1),
            (150.0, 1500.0, 15, 10.0, 1, 101, 2, "Norte", 2025, 2),
            (50.0, 500.0, 5, 10.0, 3, 103, 2, "Sur", 2025, 2),
        ],
        "venta DOUBLE, monto DOUBLE, piezas INT, precio DOUBLE, punto_venta_id BIGINT, producto_id BIGINT,"
        " canal_id BIGINT, region STRING, anio INT, mes INT",
    ).withColumns({"cliente_id": F.lit(26).cast("bigint"), "cadena_id": F.col("punto_venta_id")})


@pytest.fixture(scope="module")
def stock(spark):
    return spark.createDataFrame(
        [
            (1, 500.0, 50.0, 10, 1, 1, 101, "Norte", 2025, 1),
            (2, 300.0, 30.0, 8, 0, 2, 102, "Sur", 2025, 1),
            (3, 200.0, 20.0, 12, 1, 1, 101, "Norte", 2025, 2),
            (4, 100.0, 10.0, 6, 0, 3, 103, "Sur", 2025, 2),
        ],
        "id BIGINT, existencia DOUBLE, venta DOUBLE, dias_inventario INT, is_sobre_inventario INT,"
        " punto_venta_id BIGINT, producto_id BIGINT, region STRING, anio INT, mes INT",
    )


def test_sellout(sales, rows):
    assert tuple(sellout.sellout_kpis(sales).first()) == (500.0, 5000.0, 50, 3, 3, 10.0)
    assert rows(sellout.sales_by_region(sales)) == [
        ("Norte", 250.0, 2500.0, 25, 1),
        ("Sur", 250.0, 2500.0, 25, 2),
    ]
    assert rows(sellout.sales_by_channel(sales)) == [(1, 300.0, 3000.0, 30), (2, 200.0, 2000.0, 20)]
    assert rows(sellout.top_products_sales(sales), "producto_id", "venta") == [(101, 250.0), (102, 200.0), (103, 50.0)]
    assert rows(sellout.top_stores_sales(sales), "punto_venta_id", "venta") == [(1, 250.0), (2, 200.0), (3, 50.0)]
    assert rows(sellout.sales_monthly_trend(sales), "periodo", "venta", "monto", "piezas") == [
        ("2025-01", 300.0, 3000.0, 30),
        ("2025-02", 200.0, 2000.0, 20),
    ]


def test_sellout_of_nothing(sales):
    row = sellout.sellout_kpis(sales.where(F.lit(False))).first()
    assert tuple(row) == (0.0, 0.0, 0, 0, 0, 0.0)


def test_last_period_is_a_month_with_data(spark, rows):
    months = spark.createDataFrame([(1, 2024, 12), (1, 2025, 3)], "cliente_id BIGINT, anio INT, mes INT")
    assert rows(sellout.last_period(months)) == [(1, 2025, 3)]


def test_rollup_reports(spark, sales, rows):
    monthly = rollup.monthly_rollup(sales)
    assert rows(monthly.agg(F.sum("monto"), F.sum("piezas"))) == [(5000.0, 50)]
    assert rows(rollup.rollup_kpis(monthly)) == [(26, 5000.0, 50.0, 4, 3, 1250.0)]
    assert rows(rollup.rollup_trend(monthly), "periodo", "monto", "pdv") == [("2025-01", 3000.0, 2), ("2025-02", 2000.0, 2)]
    assert rows(rollup.same_month_by_year(monthly, 1)) == [(2025, 3000.0, 30.0)]
    products = spark.createDataFrame([(101, "A", "M"), (102, "A", "M")], "id BIGINT, nombre STRING, marca STRING")
    assert rows(rollup.top_products(monthly, products)) == [("A", "M", 4500.0, 45.0, 3), ("Sin nombre", None, 500.0, 5.0, 1)]
    chains = spark.createDataFrame([(1, " walmart "), (2, "NAN")], "id BIGINT, nombre STRING")
    assert rows(rollup.top_chains(monthly, chains), "cadena", "monto_total") == [("Sin cadena", 2500.0), ("Walmart", 2500.0)]
    channels = spark.createDataFrame([(1, "Moderno", None)], "id BIGINT, nombre STRING, segmento STRING")
    assert rows(rollup.channel_mix(monthly, channels), "canal", "segmento", "monto_total") == [
        ("Moderno", "Sin segmento", 3000.0),
        ("Sin canal", "Sin segmento", 2000.0),
    ]
    assert rows(rollup.channel_options(monthly, channels)) == [(26, "Moderno")]
    of_channel = rollup.of_channel(monthly, channels, "Moderno")
    assert rows(rollup.rollup_kpis(of_channel), "monto_total") == [(3000.0,)]
    assert rollup.of_channel(monthly, channels, "Todos") is monthly
    assert between_months(monthly, 202502, 202512).count() == 2


def test_refresh_replaces_only_its_months(spark, sales, rows, tmp_path):
    path = str(tmp_path / "rollup")
    rollup.refresh_rollup(sales, path)
    rollup.refresh_rollup(sales.withColumn("monto", F.col("monto") * 10), path, 202502, 202502)
    stored = rollup.stored_rollup(spark, path).read()
    assert rows(stored.groupBy("mes").agg(F.sum("monto")).orderBy("mes")) == [(1, 3000.0), (2, 20000.0)]
    plan = between_months(stored, 202502)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_inventory(stock, rows):
    assert tuple(inventory.inventory_kpis(stock).first()) == (1100.0, 9.0, 2, 50.0, 3, 3, 110.0)
    assert rows(inventory.inventory_by_region(stock)) == [("Norte", 700.0, 11.0, 2, 1), ("Sur", 400.0, 7.0, 0, 2)]
    assert rows(inventory.overstock_products(stock)) == [(101, 2, 700.0, 11.0)]
    assert rows(inventory.stock_vs_sales(stock), "producto_id", "ratio_inv_venta", "dias_inventario_prom") == [
        (101, 10.0, 11.0),
        (102, 10.0, 8.0),
        (103, 10.0, 6.0),
    ]
    assert rows(inventory.inventory_monthly_trend(stock), "periodo", "existencia", "dias_inventario_prom", "sobre_inventario") == [
        ("2025-01", 800.0, 9.0, 1),
        ("2025-02", 300.0, 9.0, 1),
    ]


def test_product_without_sales_has_no_ratio(stock, rows):
    unsold = stock.withColumn("venta", F.when(F.col("producto_id") == 103, 0.0).otherwise(F.col("venta")))
    built = inventory.stock_vs_sales(unsold).where("producto_id = 103")
    assert rows(built, "ratio_inv_venta") == [(None,)]


def test_catalog(spark, rows):
    products = spark.createDataFrame(
        [
            (1, "Prod A", "MarcaX", 1, 10.0, 1),
            (2, "Prod B", "MarcaX", 1, 20.0, 1),
            (3, "Prod C", "MarcaY", 0, 15.0, 2),
            (4, "Prod D", "MarcaY", 1, 25.0, 2),
        ],
        "id BIGINT, nombre STRING, marca STRING, status INT, precio DOUBLE, canal_id BIGINT",
    )
    assert tuple(catalog.catalog_summary(products).first()) == (4, 3, 2, 2, 17.5)
    assert rows(catalog.products_by_brand(products)) == [("MarcaX", 2, 2, 15.0), ("MarcaY", 2, 1, 20.0)]
    assert rows(catalog.record_by_id(products, 3), "nombre") == [("Prod C",)]


def test_catalog_search(spark, rows):
    teams = spark.createDataFrame(
        [(i, f"Equipo {i}", "GDL" if i % 2 else "MTY", None if i == 3 else f"Zona {i}") for i in range(1, 8)],
        "id BIGINT, nombre STRING, entidad STRING, region STRING",
    )
    spec = catalog.CATALOGS["cuadrillas"]
    found = catalog.matching(teams, spec, entidad="gdl")
    assert rows(catalog.search_page(found, spec, 1, 3), "id") == [(7,), (5,), (3,)]
    assert rows(catalog.search_page(found, spec, 2, 3), "id") == [(1,)]
    assert rows(catalog.search_counts(found, 2, 3)) == [(4, 2, 3, 2)]
    assert rows(catalog.search_counts(catalog.matching(teams, spec, q="nada"))) == [(0, 1, 50, 1)]
    assert catalog.matching(teams, spec, q="zona 5").count() == 1
    assert catalog.matching(teams, spec, q="EQUIPO", agencia="x").count() == 7


def test_sellout_kpis_group_by_words_of_ids_not_by_pairs(spark):
    ids = [None, -130, -1, 0, 63, 64, 2**62, 7]
    rows = [(s, p, Decimal("1.5000"), Decimal("2.00"), 3, None if p == 7 else Decimal("4.01")) for s in ids for p in (*ids, 7)]
    sales = spark.createDataFrame(
        rows, "punto_venta_id BIGINT, producto_id BIGINT, venta DECIMAL(18,4), monto DECIMAL(18,2), piezas BIGINT, precio DECIMAL(18,2)"
    )
    kpis = sellout.sellout_kpis(sales)
    assert tuple(kpis.first()) == (108.0, 144.0, 216, 7, 7, 4.01)
    plan = kpis._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Aggregate [punto_venta_id" not in plan
    many = spark.range(4_096).select(
        (F.col("id") % 64).alias("punto_venta_id"), F.floor(F.col("id") / 64).alias("producto_id"),
        *[F.lit(1).alias(c) for c in ("venta", "monto", "piezas", "precio")],
    )
    assert tuple(sellout.sellout_kpis(many).first()) == (4096.0, 4096.0, 4096, 64, 64, 1.0)


def test_exact_stores_of_top_products_shuffle_the_rollup_once(spark, sales):
    sold = sales.withColumn("producto_id", F.when(F.col("producto_id") != 103, F.col("producto_id")))
    none = sales.withColumns({"punto_venta_id": F.lit(None).cast("bigint"), "producto_id": F.lit(104).cast("bigint")})
    monthly = rollup.monthly_rollup(sold.union(none.select(sold.columns)))
    products = spark.createDataFrame(
        [(101, "A", "M"), (102, "A", "M"), (104, "B", None), (105, "C", "M")], "id BIGINT, nombre STRING, marca STRING"
    )
    top = rollup.top_products(monthly, products, exact=True)
    assert [tuple(r) for r in top.collect()] == [
        ("B", None, 5000.0, 50.0, 0, 0), ("A", "M", 4500.0, 45.0, 3, 2), ("Sin nombre", None, 500.0, 5.0, 1, 1)
    ]
    assert [tuple(r) for r in rollup.top_products(monthly, products, 1, exact=True).collect()] == [("B", None, 5000.0, 50.0, 0, 0)]
    # Words are merged for the listed products only, after their names are known, not per product and again per name.
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    explodes = [i for i, n in enumerate(plan.split("\n")) if "Generate explode" in n]
    limits = [i for i, n in enumerate(plan.split("\n")) if "GlobalLimit" in n]
    assert len(explodes) == 1 and explodes[0] < limits[-1]


def test_sales_shuffle_lines_once(spark, sf_dir):
    plan = adapters.sales(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = {t: next(n.index("Relation") for n in plan if "Relation" in n and c in n) for t, c in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))}
    assert depth["lineitem"] < depth["orders"]
