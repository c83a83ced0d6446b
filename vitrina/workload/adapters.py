"""The benchmark tables seen as the domain's tables.

Each adapter is a row-wise mapping (plus key joins) of whole tables. The benchmark data has no
missing values, so some are put in by rule to exercise the NULL handling of the jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Most visits of one rep on one benchmark day are 7 to 11; the limit is lowered to fit.
BUSY_LIMIT = 6


# Declared so that no job has to open files just to learn the columns.
BENCHMARK_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
        " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
        " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING,"
        " l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BENCHMARK_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _null_when(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


# --- field operations ---------------------------------------------------------------------------


def _store() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def repeated(dim: DataFrame) -> DataFrame:
    """A dimension some of whose rows come twice."""
    return dim.union(dim.where(F.col("id") % 3 == 0))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some visits have no client, some are planned in 2027, some last five days."""
    e = table(spark, sf_dir, "events").withColumn("store", _store())
    store = F.col("store")
    started = F.col("event_type") != "error"
    seconds = (
        F.when(F.col("event_id") % 41 == 0, -600.0)
        .when(F.col("event_id") % 307 == 0, 432_000.0)
        .otherwise(F.floor(F.col("value") * 60))
    )
    later = F.when(F.col("event_id") % 499 == 0, 1_096).otherwise(0)
    end = F.col("ts") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    lat, lon = store / 100.0 + 19.0, -store / 100.0 - 99.0
    nan = F.lit(float("nan"))
    return e.select(
        _null_when(F.col("event_id") % 211 == 0, F.col("user_id") % 4).alias("cliente_id"),
        _null_when(F.col("event_id") % 97 == 0, F.col("user_id")).alias("usuario_id"),
        ((F.col("user_id") + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)) % 26).alias("cuadrilla_id"),
        _null_when(F.col("event_id") % 53 == 0, store).alias("punto_venta_id"),
        F.date_add(F.col("ts").cast("date"), later).alias("fecha_planeada"),
        F.when(started, F.col("ts")).alias("fecha_real_inicio"),
        F.when(started, end).alias("fecha_real_final"),
        (F.col("event_type") == "signup").alias("is_tarea"),
        (F.col("event_type") == "view").alias("is_no_planeada"),
        F.when(F.col("event_id") % 89 == 0, nan)
        .when(started, lat + F.col("value") / 100000.0)
        .alias("latitude_check_in"),
        F.when(started, lon + F.col("value") / 100000.0).alias("longitude_check_in"),
        _null_when(F.col("event_id") % 83 == 0, lat).alias("latitude_pdv"),
        F.when(F.col("event_id") % 79 == 0, nan).otherwise(lon).alias("longitude_pdv"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("id"))
        .distinct()
        .select(
            "id",
            F.when(i % 15 == 7, F.concat(F.lit("aud."), i.cast("string")))
            .when(i % 29 != 5, F.concat(F.lit("PRC"), F.lpad(i.cast("string"), 3, "0")))
            .alias("username"),
            F.concat(F.lit("Rep "), i.cast("string")).alias("user_real_name"),
            F.concat(F.lit("rep"), i.cast("string"), F.lit("@example.com")).alias("email"),
            (i % 4).alias("cliente_id"),
        )
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    i = F.col("n_nationkey")
    first = n.select(
        i.cast("bigint").alias("id"),
        F.when(i % 11 == 3, F.lit("  ")).otherwise(F.col("n_name")).alias("entidad"),
        F.concat(F.lit("Ruta "), (i % 10).cast("string")).alias("ruta"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"),
        F.when(i % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("Plaza "), (i % 6).cast("string"))).alias("plaza"),
    )
    second = n.select(
        i.cast("bigint").alias("id"),
        F.when(i % 7 == 2, F.concat(F.lit("ZZ "), F.col("n_name"))).alias("entidad"),
        F.lit("Ruta X").alias("ruta"),
        F.lit("RX").alias("region"),
        F.lit("Plaza X").alias("plaza"),
    )
    return first.unionByName(second)


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")

    def cycle(values: list[str | None]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))

    return (
        table(spark, sf_dir, "events")
        .select(_store().alias("id"))
        .distinct()
        .select(
            "id",
            F.concat(F.lit("Suc "), k.cast("string")).alias("sucursal"),
            cycle([" walmart ", "SAMS", "7 eleven", "nan", "", None, "Super", "la comer"]).alias("cadena_str"),
            cycle(
                ["CDMX", "Nuevo LeÃ³n", "S/A", "09", "12345", "YUCATAN", "MÃ©xico", " Puebla ", None, "QuerÃ©taro"]
            ).alias("estado_str"),
            cycle(
                ["BENITO JUAREZ", "CuauhtÃ©moc", "S/A", "nan", "Cancun", "LeÃ³n", None, "Ãlvaro ObregÃ³n"]
            ).alias("municipio_str"),
        )
    )


def absence_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("nombre"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("clave"), F.col("p_type").alias("descripcion")
    )


def workdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("usuario_id"),
        (F.col("user_id") % 4).alias("cliente_id"),
        F.col("ts").alias("fecha"),
        (F.col("event_id") % 3).cast("int").alias("tipo"),
        F.when(F.col("event_type") == "error", F.lit("Falta ")).otherwise(F.col("event_type")).alias("incidencia"),
        F.when(F.col("event_type") == "error", F.col("event_id") % 5).alias("ausencia_id"),
    )


# --- shelf execution ----------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    place = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    )


def _pdv() -> Column:
    return _null_when(F.col("l_suppkey") == 13, F.col("l_suppkey"))


def _brand() -> Column:
    return _null_when(F.col("p_brand") == "Brand#25", F.col("p_brand"))


def _chain() -> Column:
    return _null_when(F.col("n_nationkey") == 24, F.col("n_name"))


def _out() -> Column:
    return F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_quantity") / 4)).otherwise(0).cast("int")


def _near() -> Column:
    return (F.col("l_quantity") <= 5).cast("int")


def _rep() -> Column:
    group = F.col("l_orderkey") % 50
    return _null_when(group == 49, F.concat(F.lit("P"), group.cast("string")))


def _line_id() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def _executed() -> Column:
    return _null_when(F.col("l_tax") == 0, F.col("l_linestatus") == "O")


def brand_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        _pdv().alias("pdv_id"),
        F.col("l_shipdate").cast("date").alias("fecha"),
        _brand().alias("marca"),
        _chain().alias("cadena"),
        F.col("s_name").alias("punto_venta"),
        F.concat(F.lit("M"), (F.col("s_nationkey") % 7).cast("string")).alias("municipio"),
        F.col("r_name").alias("estado"),
        F.lit(1).alias("total_visitas"),
        F.col("l_quantity").cast("int").alias("cant_sku"),
        (F.col("l_linestatus") == "O").cast("int").alias("cumple_planograma"),
        (F.col("l_returnflag") == "R").cast("int").alias("visitas_con_agotados"),
        _out().alias("cant_sku_agotados"),
        _near().alias("visitas_con_preagotados"),
        _near().alias("cant_sku_preagotados"),
    )


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        _line_id().alias("ejecucion_id"),
        _brand().alias("marca"),
        _pdv().alias("punto_venta_id"),
        F.col("p_name").alias("producto_en_riesgo"),
        F.col("l_shipdate").cast("date").alias("fecha"),
        _null_when(F.col("l_tax") == 0, _out()).alias("cant_agotados"),
        _near().alias("cant_preagotados"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        _line_id().alias("id"),
        F.col("l_shipdate").alias("fecha"),
        _rep().alias("promotor"),
        _pdv().alias("punto_venta_id"),
        _brand().alias("nombre_marca"),
        _chain().alias("cadena"),
        (F.col("s_nationkey") + 2).cast("bigint").alias("cadena_id"),
        F.col("l_quantity").cast("int").alias("cant_sku"),
        _out().alias("cant_agotados"),
        _near().alias("cant_preagotados"),
        _executed().alias("planograma"),
    )


def _supervisor() -> Column:
    return F.concat(F.lit("Sup "), (F.col("l_suppkey") % 7).cast("string"))


def brand_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        _line_id().alias("id"),
        _brand().alias("nombre_marca"),
        _rep().alias("user_real_name"),
        _supervisor().alias("supervisor"),
    )


def store_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("l_returnflag") == "R", F.lit("Falta de producto")).otherwise(F.lit("Sin novedad"))
    return _lines(spark, sf_dir).select(
        _line_id().alias("id"), _rep().alias("user_real_name"), _supervisor().alias("supervisor"), note.alias("incidencias")
    )


def competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        _line_id().alias("id"),
        _brand().alias("marca"),
        _rep().alias("user_real_name"),
        _supervisor().alias("supervisor"),
        F.when(F.col("l_discount") > 0.05, F.lit("Promo 2x1")).otherwise(F.lit("Descuento")).alias("tipo_promo"),
    )


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        _line_id().alias("id"), _rep().alias("user_real_name"), _supervisor().alias("supervisor")
    )


def stockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_report(spark, sf_dir).select(
        F.date_format("fecha", "yyyy-MM").alias("anio_mes"),
        "marca",
        "cadena",
        "punto_venta",
        "estado",
        F.col("cant_sku_agotados").alias("total_agotados"),
        F.col("cant_sku_preagotados").alias("total_preagotados"),
        F.col("cant_sku").alias("total_sku"),
        F.col("total_visitas").alias("visitas"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        _pdv().alias("punto_venta_id"),
        F.col("p_name").alias("producto"),
        F.col("s_name").alias("punto_venta"),
        F.col("r_name").alias("estado"),
        _chain().alias("cadena"),
        _brand().alias("marca"),
        F.col("l_quantity").cast("decimal(19,2)").alias("inventario"),
        _executed().alias("ejecutada"),
        F.col("l_shipdate").alias("fecha"),
        _rep().alias("promotor"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = (F.substring("p_brand", 7, 2).cast("int") <= 12).cast("int")
    return _lines(spark, sf_dir).select(
        _line_id().alias("id"),
        F.col("p_name").alias("producto"),
        _null_when(F.col("p_type") == "PROMO", F.col("p_type")).alias("categoria"),
        _chain().alias("cadena"),
        F.col("l_extendedprice").cast("decimal(19,2)").alias("precio"),
        _null_when(F.col("l_discount") == 0.1, own).alias("is_propio"),
        F.col("l_shipdate").alias("fecha"),
        _rep().alias("promotor"),
        (F.col("l_linestatus") == "O").alias("status"),
    )


def chain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("nombre")
    )


def store_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("nombre")
    )


# --- sell-out and inventory ---------------------------------------------------------------------


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    pieces = F.col("l_quantity").cast("bigint")
    cents = (_money("l_extendedprice") * 100).cast("bigint")
    # Orders meet their customers first: lines, the most rows, are shuffled once.
    placed = table(spark, sf_dir, "orders").join(places, F.col("o_custkey") == F.col("c_custkey"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.ascii("l_returnflag").cast("bigint").alias("cliente_id"),
            F.year("l_shipdate").alias("anio"),
            F.month("l_shipdate").alias("mes"),
            F.ascii("c_mktsegment").cast("bigint").alias("canal_id"),
            (F.col("c_nationkey") + 2).cast("bigint").alias("cadena_id"),
            F.col("o_custkey").alias("punto_venta_id"),
            (F.col("l_partkey") + 5).alias("producto_id"),
            _null_when(F.col("c_nationkey") == 24, F.col("r_name")).alias("region"),
            _money("l_extendedprice").alias("monto"),
            pieces.alias("piezas"),
            (_money("l_extendedprice") * (1 - F.col("l_discount")).cast("decimal(4,2)"))
            .cast("decimal(18,4)")
            .alias("venta"),
            (F.floor(cents / pieces).cast("decimal(16,0)") * F.lit(0.01).cast("decimal(3,2)"))
            .cast("decimal(18,2)")
            .alias("precio"),
        )
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_mktsegment")
    return (
        table(spark, sf_dir, "customer")
        .select("c_mktsegment")
        .distinct()
        .select(
            F.ascii(s).cast("bigint").alias("id"),
            _null_when(s == "MACHINERY", s).alias("nombre"),
            F.when(s < "C", "Moderno").when(s != "MACHINERY", "Tradicional").alias("segmento"),
        )
    )


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        i.cast("bigint").alias("id"),
        F.when(i % 5 == 0, " walmart ")
        .when(i % 5 == 1, "SAMS CLUB")
        .when(i % 5 == 2, "NAN")
        .when(i % 5 == 3, F.col("n_name"))
        .otherwise("")
        .alias("nombre"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        _null_when(F.col("p_size") == 13, F.col("p_name")).alias("nombre"),
        _brand().alias("marca"),
        (F.col("p_size") % 2).cast("int").alias("status"),
        _money("p_retailprice").alias("precio"),
        _null_when(F.col("p_type") == "PROMO", F.ascii("p_type").cast("bigint")).alias("canal_id"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    days = (F.abs(F.datediff("l_shipdate", "o_orderdate")) % 90).cast("int")
    sold = F.when(F.col("l_partkey") % 37 == 0, F.lit(0)).otherwise(_money("l_extendedprice"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(place, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            _line_id().alias("id"),
            F.col("l_suppkey").alias("punto_venta_id"),
            F.col("l_partkey").alias("producto_id"),
            _null_when(F.col("n_nationkey") == 24, F.col("r_name")).alias("region"),
            F.year("l_shipdate").alias("anio"),
            F.month("l_shipdate").alias("mes"),
            F.col("l_quantity").cast("decimal(18,2)").alias("existencia"),
            sold.cast("decimal(18,2)").alias("venta"),
            _null_when(F.col("l_tax") == 0, days).alias("dias_inventario"),
            (days > 60).cast("int").alias("is_sobre_inventario"),
        )
    )


# --- text, dump and exported views --------------------------------------------------------------


def broken_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.col("text")
    for good, bad in (("é", "Ã©"), ("ó", "Ã³"), ("á", "Ã¡"), ("ú", "ÃÂº"), ("ñ", "Ã±")):
        broken = F.replace(broken, F.lit(good), F.lit(bad))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", broken.alias("texto"))


def _statements(rows: DataFrame, name: str, key: Column, per_statement: int, tuple_text: Column) -> DataFrame:
    """INSERT statements of up to ``per_statement`` consecutive keys each."""
    grouped = rows.groupBy(F.floor(key / per_statement)).agg(
        F.array_join(F.collect_list(tuple_text), ",").alias("v")
    )
    return grouped.select(F.concat(F.lit(f"INSERT INTO `{name}` VALUES "), F.col("v")).alias("statement"))


def dump(spark: SparkSession, sf_dir: str, per_statement: int = 50) -> DataFrame:
    """Dump statements of three tables, built from the benchmark rows."""

    def text(c: Column) -> Column:
        return F.concat(F.lit("'"), c, F.lit("'"))

    part, customer, nation = (table(spark, sf_dir, t) for t in ("part", "customer", "nation"))
    number = F.col("p_partkey").cast("string")
    named = F.concat(F.col("p_name"), F.lit(" (O\\'Hara, 50%) \\\\"))
    flag = F.when(F.col("p_size") % 2 == 1, F.lit("_binary '\x01'")).otherwise(F.lit("_binary '\\0'"))
    brand = F.when(F.col("p_brand") == "Brand#25", F.lit("NULL")).otherwise(text(F.col("p_brand")))
    price = _money("p_retailprice").cast("string")
    fields = [number, text(named), brand, flag, price]
    short = F.col("p_size") == 50
    part_tuple = F.when(short, F.concat(F.lit("("), F.concat_ws(",", *fields[:4]), F.lit(")"))).otherwise(
        F.concat(F.lit("("), F.concat_ws(",", *fields), F.lit(")"))
    )
    parts = _statements(part, "part", F.col("p_partkey"), per_statement, part_tuple)
    customers = _statements(
        customer,
        "customer",
        F.col("c_custkey"),
        50,
        F.concat(F.lit("("), F.col("c_custkey").cast("string"), F.lit(","), text(F.col("c_name")), F.lit(")")),
    )
    nations = _statements(
        nation,
        "nation",
        F.col("n_nationkey"),
        10,
        F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(","), text(F.col("n_name")), F.lit(")")),
    )
    return parts.unionByName(customers).unionByName(nations)


def dump_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dump statements with a CREATE TABLE, a column list in another order and escaped text."""
    create = (
        "-- dump\r\nCREATE TABLE `supplier` (\r\n  `id` bigint NOT NULL,\r\n  `nombre` text,\r\n  `nota` text,\r\n"
        "  PRIMARY KEY (`id`)\r\n) ENGINE=InnoDB"
    )
    number, even = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 2 == 0
    note = F.concat(F.lit("'uno\\ndos\\t\\\"tres\\\" \\\\n; "), number, F.lit("'"))
    name = F.concat(F.lit("'"), F.col("s_name"), F.lit("'"))
    listed = F.concat(F.lit("INSERT INTO `supplier` (`nota`, `id`, `nombre`) VALUES ("), F.concat_ws(",", note, number, name), F.lit(")"))
    bare = F.concat(F.lit("INSERT INTO `supplier` VALUES ("), F.concat_ws(",", number, name, F.lit("NULL")), F.lit(")"))
    rows = table(spark, sf_dir, "supplier").select(F.when(even, listed).otherwise(bare).alias("value"))
    other = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("INSERT INTO `nation` VALUES ("), F.col("n_nationkey").cast("string"), F.lit(",'x')")).alias("value")
    )
    head = table(spark, sf_dir, "region").where(F.col("r_regionkey") == 0).select(F.lit(create).alias("value"))
    return head.union(rows).union(other)


def csv_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("nombre"),
        F.concat(F.lit('dijo "si",\n'), F.col("p_brand")).alias("nota"),
    )


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of CSV files, a file per partition, each with a header; every fifth row lacks its second field."""
    number = F.col("p_partkey").cast("string")
    line = F.when(F.col("p_partkey") % 5 == 0, number).otherwise(F.concat_ws(",", number, "p_name"))

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        header = pd.DataFrame({"value": ["id,nombre"]})
        for batch in batches:
            yield pd.concat([header, batch])
            header = header.iloc[:0]

    return table(spark, sf_dir, "part").select(line.alias("value")).mapInPandas(headed, "value string")


def _day_text() -> Column:
    return F.when(F.col("l_linenumber") == 3, "sin fecha").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))


def _bit_text(c: Column) -> Column:
    marks = F.array(*[F.lit(m) for m in ("0x00", "0x01", "1", "0", "true", "x", "False")])
    return F.element_at(marks, (c % 7 + 1).cast("int"))


def _number_text(c: Column) -> Column:
    return F.when(c % 11 == 0, "n/d").otherwise(c.cast("string"))


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text exported rows, the union of the columns the cleaning jobs read."""
    line, qty, part = F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("clave"),
        _day_text().alias("fecha"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" 08:15:00")).alias("inicio_jornada"),
        _day_text().alias("fin_jornada"),
        F.when(line == 5, "2024-13").otherwise(F.date_format("l_shipdate", "yyyy-MM")).alias("anio_mes"),
        _number_text(qty).alias("horas_laboradas"),
        _number_text(qty * 2).alias("pct_cumplimiento_plan"),
        _number_text(qty).alias("pct_cumplimiento_visitas"),
        _number_text(qty % 9).alias("cant_agotados"),
        _number_text(qty % 5).alias("cant_sku"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("0", "5", "15", "100", "101", None, "-1", "0.5", "50")]),
            (part % 9 + 1).cast("int"),
        ).alias("pct_quiebre"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("49", "79", "100", "0", "101", None, "49.5", "80", "x")]),
            (part % 9 + 1).cast("int"),
        ).alias("pct_planograma"),
        _number_text(qty).alias("pct_visitas_agotados"),
        _number_text(qty).alias("inventario"),
        _number_text(qty + 3).alias("precio"),
        _bit_text(part).alias("ejecutada"),
        _bit_text(part).alias("is_propio"),
        _bit_text(part + 1).alias("status"),
        _bit_text(part + 2).alias("planograma"),
        _bit_text(part + 3).alias("con_agotados"),
        _null_when(line == 2, F.col("l_returnflag")).alias("marca"),
        _null_when(line == 2, F.col("l_returnflag")).alias("nombre_marca"),
        _null_when(line == 4, F.col("l_linestatus")).alias("cadena"),
        _null_when(line == 6, F.col("l_linestatus")).alias("entidad"),
        _null_when(line == 6, F.col("l_linestatus")).alias("promotor"),
        _null_when(line == 6, F.col("l_linestatus")).alias("categoria"),
        _null_when(line == 6, F.col("l_linestatus")).alias("producto_en_riesgo"),
    )
