"""Search through trigrams and pages by number against the scan."""

import random

import pytest
from pyspark.sql import functions as F

from vitrina.operators.indexes import PageIndex, TrigramIndex, trigrams
from vitrina.plans import catalog
from vitrina.plans.catalog import CATALOGS


@pytest.fixture(scope="module")
def reps(spark):
    rng = random.Random(2)
    bits = ["Ana", "ANA", "Peña", "İz", "x", "_", "%", " ", "rep 1", "\\", "日本語", "mañana"]

    def text():
        return None if rng.random() < 0.1 else "".join(rng.choices(bits, k=rng.randint(0, 5)))

    rows = [(i // 2 * 7, text(), text(), text(), i % 4) for i in range(400)]  # two rows of each id
    return spark.createDataFrame(rows, "id long, user_real_name string, username string, email string, n int")


def test_trigrams(spark):
    df = spark.createDataFrame([("AbcAbc",), ("ab",), ("",), (None,), ("ñÑñÑ",)], "t string")
    assert [r[0] for r in df.select(trigrams(F.col("t"))).collect()] == [["abc", "bca", "cab"], [], [], [], ["ñññ"]]


WORDS = ["ana", "ANA", "peña", "rep 1", "a", "an", "%", "_", "ana%rep", "ana_x", "\\\\", "日本語", "語m", "mañana", "nowhere", "İz ", "anaana", "x\\%", ""]


@pytest.mark.parametrize("block", [100, 1_000_000])
def test_indexed_search_equals_scan(spark, reps, tmp_path, block):
    index = TrigramIndex.build(reps, ["user_real_name", "username", "email"], str(tmp_path / "i"), block=block)
    spec = CATALOGS["promotores"]
    for q in WORDS:
        scan = sorted(r.id for r in catalog.matching(reps, spec, q=q).collect())
        assert sorted(r.id for r in catalog.indexed_matching(index, spec, q=q).collect()) == scan, q


def test_filters_and_word_together(spark, tmp_path):
    rng = random.Random(4)
    names = ["Zona Norte", "zona sur", "Norteña", None, "ab"]
    rows = [(i, *(rng.choice(names) for _ in range(5))) for i in range(200)]
    teams = spark.createDataFrame(rows, "id long, nombre string, puesto string, agencia string, entidad string, region string")
    spec = CATALOGS["cuadrillas"]
    index = catalog.build_index(teams, spec, str(tmp_path / "i"))
    for wanted in ({"q": "norte"}, {"q": "norte", "entidad": "sur"}, {"entidad": "zona", "agencia": "norte"}, {"q": "ab", "entidad": "zona"}, {"q": "ab"}, {}):
        scan = sorted(r.id for r in catalog.matching(teams, spec, **wanted).collect())
        found = catalog.indexed_matching(index, spec, **wanted)
        assert sorted(r.id for r in found.collect()) == scan, wanted
        assert found.columns == teams.columns


def test_only_blocks_with_candidates_are_read(spark, tmp_path):
    df = spark.range(1_000).select("id", F.concat(F.lit("name "), F.col("id")).alias("nombre"))
    index = TrigramIndex.build(df, ["nombre"], str(tmp_path / "i"), block=100)
    found = index.search([(["nombre"], "e 73")])
    assert sorted(r.id for r in found.collect()) == [73, *range(730, 740)]
    assert {f.split("bloque=")[1].split("/")[0] for f in found.inputFiles() if "bloque=" in f and "/filas/" in f} >= {"0", "7"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bloque" in plan and "cubeta" in plan
    # Ids of a trigram lie in one folder of 64.
    assert index.search([(["nombre"], "zzz")]).count() == 0


def test_a_text_is_indexed_once_per_block(spark, tmp_path):
    repeated = spark.range(2_000).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("Marca "), F.col("id") % 4)).alias("nombre"), F.lit("ab").alias("puesto"))
    index = TrigramIndex.build(repeated, ["nombre", "puesto"], str(tmp_path / "i"), block=1_000)
    # Two blocks of three texts with five trigrams each; a row for every id before.
    assert spark.read.parquet(f"{index.path}/trigramas").count() == 2 * 3 * 5
    assert index.search([(["nombre"], "marca 3")]).count() == 500
    assert index.search([(["nombre"], "marca 3"), (["nombre", "puesto"], "AB")]).count() == 500
    assert index.search([(["nombre"], "marca 3"), (["puesto", "nombre"], "Mar%a")]).count() == 500


def test_blocks_that_hold_all_texts_of_a_search(spark, tmp_path):
    rows = [(0, "norte", "x1y"), (1, "norte", None), (100, "norte", None), (200, "sur", "x1y"), (300, "norteña", "_x1y_"), (None, "norte", "x1y")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    index = TrigramIndex.build(df, ["a", "b"], str(tmp_path / "i"), block=100)
    conditions = [(["a"], "NORTE"), (["b"], "x1y")]
    assert [sorted(r.bloque for r in index.candidates(c).collect()) for c in conditions] == [[0, 1, 3], [0, 2, 3]]
    found = index.search(conditions)
    assert sorted(r.id for r in found.collect()) == [0, 300]
    assert found.columns == ["id", "a", "b"]


@pytest.mark.parametrize("newest", [True, False])
def test_pages_by_number_equal_the_sorted_listing(spark, tmp_path, newest):
    df = spark.range(1_234).select((F.col("id") * 3 % 1_237).alias("id"), (F.col("id") % 5).alias("n"))
    listed = sorted(((r.id, r.n) for r in df.collect()), reverse=newest)
    index = PageIndex.build(df, ["id"], str(tmp_path / "p"), newest, rows=100)
    for number, size in ((1, 50), (2, 50), (7, 33), (25, 50), (3, 500), (26, 50), (1, 2_000)):
        first = (number - 1) * size
        assert [tuple(r) for r in index.page(number, size).collect()] == listed[first : first + size], (number, size)


def test_a_deep_page_reads_one_range(spark, tmp_path):
    df = spark.range(50_000).select("id")
    index = PageIndex.build(df, ["id"], str(tmp_path / "p"), rows=5_000)
    found = index.page(4_000, 10)
    assert [r.id for r in found.collect()] == list(range(10_009, 9_999, -1))
    metrics = index.spark.read.parquet(f"{index.path}/conteos").collect()
    assert len(metrics) == 10 and sum(r.n for r in metrics) == 50_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tramo" in plan or "PartitionFilters: [tramo" in plan


def test_many_ranges_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vitrina.operators.indexes.FOLDER_ROWS", 2_000, raising=False)
    df = spark.range(10_000).select((F.col("id") * 7 % 10_007).alias("id"))
    listed = sorted((r.id for r in df.collect()), reverse=True)
    index = PageIndex.build(df, ["id"], str(tmp_path / "p"), rows=20)
    stored = spark.read.parquet(f"{index.path}/filas")
    # A folder, a task and a sample for every range before.
    assert stored.select("tramo").distinct().count() == 5
    assert spark.read.parquet(f"{index.path}/conteos").count() >= 500
    for number, size in ((1, 30), (8, 25), (70, 30), (3, 4_000), (100, 100), (101, 100), (2, 9_990)):
        found = index.page(number, size)
        assert [r.id for r in found.collect()] == listed[(number - 1) * size : number * size], (number, size)
    assert found.columns == ["id"]


def test_pages_of_equal_keys_lose_no_row(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("n")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    index = PageIndex.build(df, ["k"], str(tmp_path / "p"), rows=20)
    pages = [r for i in range(1, 8) for r in index.page(i, 50).collect()]
    assert [r.k for r in pages] == [2] * 100 + [1] * 100 + [None] * 100


def test_empty_catalogue(spark, tmp_path):
    none = spark.createDataFrame([], "id long, nombre string")
    assert TrigramIndex.build(none, ["nombre"], str(tmp_path / "i")) is not None
    assert PageIndex.build(spark.range(1), ["id"], str(tmp_path / "p")).page(2, 10).count() == 0
