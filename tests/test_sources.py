import pytest
from pyspark.sql import functions as F

from vitrina.plans import cleaning, geofence
from vitrina.sources import dump, export, profile, views
from vitrina.sources.tables import Tables, write_parquet
from vitrina.workload import adapters

DUMP = """-- a dump
DROP TABLE IF EXISTS `canal`;
CREATE TABLE `canal` (
  `id` bigint(20) NOT NULL,
  `nombre` varchar(255) DEFAULT NULL,
  `activo` bit(1) NOT NULL,
  `precio` decimal(10,2) DEFAULT NULL,
  PRIMARY KEY (`id`),
  KEY `k_nombre` (`nombre`)
) ENGINE=InnoDB;
INSERT INTO `canal` VALUES (1,'José (hijo), \\'el\\' \\\\ 5%',_binary '\x01',-10.50),(2,NULL,_binary '\\0',NULL);
--
-- Dumping data for table `canal`
--

INSERT INTO `canal` VALUES (3,'corta',_binary '\x00'),(4,'',_binary '\x01',1e3),(x,'y',_binary '\x01','n/d');
INSERT INTO `otra` VALUES (1,'INSERT INTO `canal` VALUES (9)');
"""
CANAL = "id BIGINT, nombre STRING, activo BOOLEAN, precio DECIMAL(10,2)"


@pytest.fixture(params=["UTF-8", "ISO-8859-1"])
def routed(spark, tmp_path, request):
    path = tmp_path / "dump.sql"
    path.write_bytes(DUMP.encode(request.param))
    return dump.route(dump.read_statements(spark, str(path), request.param))


def test_dump_routes_statements(routed, rows):
    counts = routed.groupBy("tabla").count().orderBy("tabla")
    assert rows(counts) == [("canal", 3), ("otra", 1)]
    assert rows(dump.route(routed.drop("tabla"), ["otra"]), "tabla") == [("otra",)]


def test_dump_written_by_table(spark, routed, tmp_path):
    dump.write_routed(routed, str(tmp_path / "sql"))
    assert spark.read.parquet(str(tmp_path / "sql" / "tabla=canal")).count() == 3


def test_enriched_visits_written_by_client(spark, sf_dir, tmp_path):
    geo = geofence.enriched_visits(
        adapters.visits(spark, sf_dir), adapters.stores(spark, sf_dir), adapters.teams(spark, sf_dir), [1, 3]
    )
    geofence.write_enriched(geo, str(tmp_path / "geo"))
    stored = spark.read.parquet(str(tmp_path / "geo"))
    assert sorted(p.name for p in (tmp_path / "geo").glob("cliente_id=*")) == ["cliente_id=1", "cliente_id=3"]
    assert stored.count() == geo.count() > 0
    assert set(stored.columns) == set(geo.columns)


def test_dump_columns(routed, rows):
    assert rows(dump.declared_columns(routed)) == [("canal", ["id", "nombre", "activo", "precio"])]


def test_dump_rows(routed):
    built = dump.load_rows(routed, "canal", CANAL).orderBy(F.col("id").asc_nulls_last()).collect()
    assert [(r.id, r.nombre, r.activo, None if r.precio is None else float(r.precio)) for r in built] == [
        (1, "José (hijo), 'el' \\ 5%", True, -10.5),
        (2, None, False, None),
        (4, "", True, 1000.0),
    ]


def test_dump_counts_rejected_rows(routed, rows):
    # the row with three fields, and the one whose first field is no literal
    assert rows(dump.rejected_rows(routed, "canal", 4)) == [(5, 2)]


def test_dump_survives_long_values(spark, rows):
    long_text = "a\\'b" * 200_000
    lines = spark.createDataFrame([(f"INSERT INTO `t` VALUES (1,'{long_text}'),(2,'z')",)], "statement STRING")
    built = dump.load_rows(dump.route(lines), "t", "id INT, s STRING")
    assert rows(built.select("id", F.length("s")).orderBy("id")) == [(1, 600_000), (2, 1)]


def test_tables_resolver(spark, tmp_path, rows):
    frame = spark.createDataFrame([(1, "a")], "id BIGINT, nombre STRING")
    write_parquet(frame, str(tmp_path / "segundo" / "cadena.parquet"))
    write_parquet(frame.withColumn("id", F.lit(2).cast("bigint")), str(tmp_path / "cliente_x" / "cadena.parquet"))
    tables = Tables(spark, str(tmp_path), ("primero", "segundo"))
    assert rows(tables.read("cadena")) == [(1, "a")]
    assert rows(tables.read("cadena", "cliente_x")) == [(2, "a")]
    with pytest.raises(FileNotFoundError):
        tables.read("nada")
    tables.register("cadena")
    assert spark.sql("SELECT nombre FROM cadena WHERE id = 1").count() == 1


def test_csv_view_to_clean_table(spark, tmp_path, rows):
    folder = tmp_path / "v.csv"
    folder.write_text('fecha,ejecutada,inventario,marca\n2024-01-05,0x01,3.5,"A ""x"", b"\nmal,x,n/d,\n', encoding="utf-8")
    view = views.read_csv(spark, str(folder), ["fecha", "ejecutada", "inventario", "marca"])
    clean = cleaning.clean_zero_sales(view)
    assert rows(clean, "anio", "mes", "ejecutada", "inventario", "marca") == [
        (2024, 1, True, 3.5, 'A "x", b'),
        (None, None, None, None, "Sin dato"),
    ]
    views.write_csv(clean, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_report_bundle(spark, tmp_path):
    frames = {"resumen": spark.range(1), "detalle": spark.range(3)}
    export.write_report(frames, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "detalle")).count() == 3
    export.write_report(frames, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p" / "resumen")).count() == 1


def test_profiles(spark, rows):
    df = spark.createDataFrame([("2024-01-01", "a"), ("2024-01-03", None), (None, "Ã")], "d STRING, c STRING")
    assert rows(profile.null_profile(df)) == [(3, "d", 1), (3, "c", 1)]
    row = profile.table_profile(df, "d").first()
    assert (row.filas, str(row.dia_min), str(row.dia_max), row.columnas) == (3, "2024-01-01", "2024-01-03", 2)
    assert rows(profile.value_counts(df, "c")) == [("a", 1), ("Ã", 1)]
    assert rows(profile.broken_values(df, "c")) == [(1,)]
