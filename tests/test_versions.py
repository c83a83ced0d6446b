"""Tables that change in one commit, and exact store counts from the stored roll-up."""

import random

import pytest
from pyspark.sql import functions as F

from vitrina.operators.filters import between_months
from vitrina.plans import rollup
from vitrina.sources.versions import CommitConflict, VersionedTable, partition_values

COLUMNS = "cliente_id long, anio int, mes int, canal_id long, cadena_id long, producto_id long, punto_venta_id long, monto decimal(18,2), piezas long"


def made_sales(spark, seed=1, rows=600):
    rng = random.Random(seed)
    stores = [None, -1, -64, -65, 0, 63, 64, 65, 127, 128, 10**12, 2**62, *range(300, 340)]
    data = [
        (rng.choice([1, 2, None]), rng.choice([2023, 2024]), rng.randint(1, 3), rng.randint(1, 2), rng.randint(1, 3), rng.randint(1, 4), rng.choice(stores), rng.randint(1, 99), rng.randint(1, 9))
        for _ in range(rows)
    ]
    from decimal import Decimal

    return spark.createDataFrame([(*r[:7], Decimal(r[7]), r[8]) for r in data], COLUMNS)


def distinct_stores(sales, *keys):
    counts = sales.groupBy(*keys).agg(F.countDistinct("punto_venta_id").alias("n"))
    return sorted((tuple(r) for r in counts.collect()), key=repr)


@pytest.mark.parametrize("keys", [["cliente_id"], ["anio", "mes"], ["producto_id", "canal_id"], list(rollup.GRAIN)])
def test_exact_stores_of_any_grouping(spark, keys):
    sales = made_sales(spark)
    merged = rollup.exact_stores(rollup.monthly_rollup(sales), keys)
    found = sorted((tuple(r) for r in merged.collect()), key=repr)
    assert found == [r for r in distinct_stores(sales, *keys) if r[-1]]


def test_grain_counts_are_bitmap_counts(spark):
    sales = made_sales(spark, 2)
    found = sorted((tuple(r) for r in rollup.monthly_rollup(sales).select(*rollup.GRAIN, "pdvs").collect()), key=repr)
    assert found == distinct_stores(sales, *rollup.GRAIN)


def test_reports_need_the_stored_table_alone(spark, tmp_path):
    sales, path = made_sales(spark, 3), str(tmp_path / "rollup")
    for months in ((2023, 1), (2023, 2), (2023, 3)):
        rollup.refresh_rollup(sales, path, months[0] * 100 + months[1], months[0] * 100 + months[1])
    rollup.refresh_rollup(sales, path, 202401, 202412)
    stored = rollup.stored_rollup(spark, path).read()
    kpis = rollup.rollup_kpis(stored, exact=True)
    assert sorted((((r.cliente_id, r.pdv_distinct)) for r in kpis.collect()), key=repr) == distinct_stores(sales, "cliente_id")
    trend = rollup.rollup_trend(stored, exact=True)
    assert sorted(((r.cliente_id, r.anio, r.mes, r.pdv_distinct) for r in trend.collect()), key=repr) == distinct_stores(sales, "cliente_id", "anio", "mes")
    names = spark.createDataFrame([(1, "A", "M"), (2, "A", "M"), (3, None, "M")], "id long, nombre string, marca string")
    top = rollup.top_products(stored, names, exact=True)
    label = F.when(F.col("producto_id") <= 2, "A")
    brand = F.when(F.col("producto_id") <= 3, "M")
    expected = distinct_stores(sales.withColumn("nombre", label).withColumn("marca", brand), "nombre", "marca")
    assert sorted(((r.producto, r.marca, r.pdv_distinct) for r in top.collect()), key=repr) == sorted(
        ((n or "Sin nombre", m, c) for n, m, c in expected), key=repr
    )
    chains = rollup.top_chains(stored, names.select("id", "nombre"), exact=True)
    assert sum(r.pdv_distinct for r in chains.collect()) == sum(
        r[-1] for r in distinct_stores(sales.withColumn("c", F.when(F.col("cadena_id") <= 2, "A")), "c")
    )
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "punto_venta_id" not in plan and all("/rollup/data/" in f for f in top.inputFiles())


def months(table, number=None):
    return sorted((r.anio, r.mes, int(r.monto)) for r in table.read(number).groupBy("anio", "mes").agg(F.sum("monto").alias("monto")).collect())


def test_readers_see_all_of_a_refresh_or_none(spark, tmp_path, monkeypatch):
    sales, path = made_sales(spark, 4), str(tmp_path / "rollup")
    assert rollup.refresh_rollup(sales, path) == 1
    table = rollup.stored_rollup(spark, path)
    before = months(table)
    changed = sales.where("NOT (anio = 2023 AND mes = 2)").withColumn("monto", (F.col("monto") * 2).cast("decimal(18,2)"))

    def stop(self, schema, partitions, after):
        # New files lie beside the old ones here, and nothing was taken out.
        assert months(self) == before
        raise OSError("stopped between the steps")

    with monkeypatch.context() as patched:
        patched.setattr(VersionedTable, "commit", stop)
        with pytest.raises(OSError):
            rollup.refresh_rollup(changed, path, 202301, 202312)
    assert months(table) == before and table.versions() == [1]
    reader = table.read()  # opened before the commit
    assert rollup.refresh_rollup(changed, path, 202301, 202312) == 2
    after = [(y, m, v * 2 if y == 2023 else v) for y, m, v in before if (y, m) != (2023, 2)]
    assert months(table) == after
    assert months(table, 1) == before
    assert reader.groupBy("anio", "mes").count().count() == 6
    # Three folders of the first state, and those of the change that was stopped.
    assert table.expire(keep=1) == 3 + 2
    assert months(table) == after and table.versions() == [2]


def test_second_of_two_changes_fails(spark, tmp_path, monkeypatch):
    sales, path = made_sales(spark, 5), str(tmp_path / "rollup")
    rollup.refresh_rollup(sales, path)
    stage = VersionedTable.stage
    raced = []

    def slow(self, df):
        written = stage(self, df)
        if not raced:
            raced.append(True)
            rollup.refresh_rollup(sales, path, 202401, 202401)
        return written

    monkeypatch.setattr(VersionedTable, "stage", slow)
    with pytest.raises(CommitConflict):
        rollup.refresh_rollup(sales, path, 202301, 202301)
    assert rollup.stored_rollup(spark, path).versions() == [1, 2]


def test_emptied_and_missing_tables(spark, tmp_path):
    sales, path = made_sales(spark, 6), str(tmp_path / "rollup")
    table = rollup.stored_rollup(spark, path)
    with pytest.raises(FileNotFoundError):
        table.read()
    rollup.refresh_rollup(sales, path)
    columns = table.read().columns
    rollup.refresh_rollup(sales.limit(0), path)
    assert table.read().count() == 0 and table.read().columns == columns


def test_range_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rollup.refresh_rollup(made_sales(spark, 7), path)
    picked = between_months(rollup.stored_rollup(spark, path).read(), 202402, 202403)
    assert {(r.anio, r.mes) for r in picked.select("anio", "mes").distinct().collect()} == {(2024, 2), (2024, 3)}
    assert "PartitionFilters: [isnotnull" in picked._jdf.queryExecution().executedPlan().toString()


def test_partition_values():
    assert partition_values("anio=2024/mes=1") == {"anio": "2024", "mes": "1"}
