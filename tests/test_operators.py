import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrina.operators import filters, lookups, quantiles, ranking, reshape
from vitrina.plans.geofence import DETAIL_LABELS
from vitrina.plans.workday import ITINERARY_LABELS
from vitrina.sources.tables import Tables


def test_chosen_skips_the_all_choices(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "marca STRING, n INT")
    for everything in (None, "Todas", "todas", "Todos", ""):
        assert filters.chosen(df, marca=everything).count() == 2
    assert filters.chosen(df, marca="a", n=1).count() == 1
    assert filters.chosen(df, marca="a' OR '1'='1").count() == 0


@pytest.mark.parametrize("kind", ["date", "timestamp_ntz", "timestamp", "string"])
def test_day_range_includes_the_whole_last_day(spark, kind):
    df = spark.createDataFrame([("2024-01-30",), ("2024-01-31 23:59:59",), ("2024-02-01",)], "t STRING")
    df = df.select((F.col("t").cast("timestamp_ntz").cast(kind)).alias("t"))
    assert filters.between_days(df, "t", "2024-01-31", "2024-01-31").count() == 1
    assert filters.between_days(df, "t", end="2024-01-31").count() == 2
    assert filters.between_days(df, "t").count() == 3


def test_day_range_reaches_the_scan(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = filters.between_days(lines, "l_shipdate", "1996-01-01", "1996-12-31")._jdf.queryExecution().toString()
    pushed = [p for p in plan.split("\n") if "PushedFilters" in p][0]
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed


def test_top_breaks_ties_by_key(spark, rows):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), (None, 5)], "k STRING, n INT")
    assert rows(ranking.top(df, "n", ["k"], 3)) == [("c", 9), ("a", 5), ("b", 5)]


def test_options(spark, rows):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "k STRING")
    assert rows(ranking.options(df, "k")) == [("a",), ("b",)]


def test_one_row_per_id(spark, rows):
    df = spark.createDataFrame(
        [(1, " ", "r9"), (1, "b", "r1"), (1, "a", None), (2, None, "r2"), (2, "", "r1")],
        "id BIGINT, entidad STRING, ruta STRING",
    )
    assert sorted(rows(lookups.one_row_per_id(df, "entidad", "ruta"))) == [(1, "a", None), (2, None, "r1")]


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_exact_quantiles(spark, slices):
    """Against numpy: ties, one hot value, a single row, skewed values, any number of slices."""
    rng = random.Random(7)
    groups = {
        "uniforme": [round(rng.uniform(0, 1000), 2) for _ in range(3001)],
        "caliente": [5.0] * 2000 + [float(i) for i in range(500)],
        "sesgado": [rng.expovariate(1) ** 6 for _ in range(2500)],
        "uno": [3.25],
        "dos": [1.0, 2.0],
    }
    data = [(k, v) for k, vs in groups.items() for v in vs] + [("uno", None)]
    df = spark.createDataFrame(data, "k STRING, v DOUBLE").repartition(7)
    wanted = {"q1": 0.25, "mediana": 0.5, "q3": 0.75, "ultimo": 1.0}
    built = quantiles.sliced_quantiles(df, ["k"], "v", wanted, slices=slices).collect()
    assert len(built) == len(groups)
    for row in built:
        for name, p in wanted.items():
            assert row[name] == pytest.approx(np.quantile(groups[row.k], p), rel=1e-12), (row.k, name)


def test_weighted_quantiles_equal_repeated_rows(spark):
    df = spark.createDataFrame([("k", 1.0, 3), ("k", 2.0, 1), ("k", 9.0, 4)], "k STRING, v DOUBLE, w INT")
    row = quantiles.exact_quantiles(df, ["k"], "v", {"q": 0.5, "r": 0.9}, "w").first()
    repeated = [1.0] * 3 + [2.0] + [9.0] * 4
    assert (row.q, row.r) == (np.quantile(repeated, 0.5), np.quantile(repeated, 0.9))


def test_display_names(spark):
    for labels in (DETAIL_LABELS, ITINERARY_LABELS):
        df = spark.createDataFrame([tuple("x" for _ in labels)], list(labels))
        assert reshape.for_display(df, labels).columns == list(labels.values())


@pytest.mark.parametrize("bins", [16, 4096])
def test_quantiles_by_rank_selection(spark, monkeypatch, bins):
    """Ties, one-valued and small groups, values of very different size, weights."""
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(5)
    groups = {
        "spread": np.concatenate([rng.normal(0, 1, 300), rng.lognormal(5, 6, 100), [-1e12, 1e12, 1e-12]]),
        "ties": rng.integers(0, 4, 200).astype(float),
        "one": np.array([3.5]),
        "same": np.full(50, -2.25),
        "two": np.array([1.0, np.nextafter(1.0, 2)]),
    }
    data = [(k, float(v), int(w)) for k, values in groups.items() for v, w in zip(values, rng.integers(1, 4, len(values)))]
    df = spark.createDataFrame([*data, ("spread", None, 1), ("empty", None, 1), (None, 5.0, 1)], "k string, v double, w long").repartition(3)
    wanted = {"lo": 0.0, "q1": 0.25, "med": 0.5, "q9": 0.9, "hi": 1.0}
    for weight in (None, "w"):
        built = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", wanted, weight).collect()}
        assert set(built) == set(groups)
        for k in groups:
            values = np.repeat(*map(np.array, zip(*[(v, w if weight else 1) for g, v, w in data if g == k])))
            for name, p in wanted.items():
                assert built[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300), (k, name)


def test_quantiles_without_join_or_gathered_groups(spark):
    df = spark.range(20_000).selectExpr("id % 2 AS k", "cast(id * 7919 % 20011 as double) AS v")
    built = quantiles.exact_quantiles(df, ["k"], "v", {"q": 0.5})
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", {"q": 0.5}).count() == 0


def test_quantiles_of_many_groups_and_infinite_values(spark, monkeypatch):
    df = spark.range(300).selectExpr("id % 60 AS k", "cast(id as double) AS v")
    expected = {k: np.quantile(np.arange(k, 300, 60.0), 0.3) for k in range(60)}
    monkeypatch.setattr(quantiles, "MOST_RANGES", 5)
    assert {r.k: r.q for r in quantiles.exact_quantiles(df, ["k"], "v", {"q": 0.3}).collect()} == pytest.approx(expected)
    endless = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, float("inf"))], "k int, v double")
    assert quantiles.exact_quantiles(endless, ["k"], "v", {"q": 0.5}).first().q == 2.0


def test_stored_dimension_is_not_grouped_again(spark, rows, tmp_path):
    dim = spark.createDataFrame(
        [(1, None, 5), (1, "b", 7), (1, "b", 6), (2, None, None), (None, "x", 1)], "id long, nombre string, k int"
    )
    tables = Tables(spark, str(tmp_path))
    tables.write_dimension(dim, "articulos")
    stored = tables.dimension("articulos")
    assert lookups.is_unique(stored) and not lookups.is_unique(dim) and not lookups.is_unique(lookups.unmarked(stored))
    assert sorted(rows(stored)) == [(1, "b", 6), (2, None, None)]
    fact = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "x long")
    expected = sorted(rows(lookups.with_attributes(fact, dim, "x", {"n": "nombre"})), key=str)
    joined = lookups.with_attributes(fact, stored, "x", {"n": "nombre"})
    assert sorted(rows(joined), key=str) == expected
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "ReadSchema: struct<id:bigint,nombre:string>" in plan
    # A union repeats ids: without the mark they are one row again.
    twice = lookups.unmarked(stored.union(stored))
    assert sorted(rows(lookups.with_attributes(fact, twice, "x", {"n": "nombre"})), key=str) == expected
