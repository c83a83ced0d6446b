"""Monthly sell-out roll-up and the reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.functions.clock import period_text
from vitrina.functions.numbers import amount, half_up, ratio, total
from vitrina.functions.text import or_default, report_chain
from vitrina.operators.filters import between_months
from vitrina.operators.lookups import unique_by_id, with_attributes
from vitrina.operators.ranking import ascending, descending, top
from vitrina.sources.versions import VersionedTable

GRAIN = ["cliente_id", "anio", "mes", "canal_id", "cadena_id", "producto_id"]

# Length of the rankings.
RANKED = 15


def monthly_rollup(sales: DataFrame) -> DataFrame:
    """Sell-out detail by client, month, channel, chain and product. ``pdvs`` counts the stores of the
    grain; ``tiendas`` holds them as a bitmap, a list of ``(palabra, bits)`` with 64 store ids to a word. Counts of
    several groups count a store more than once; bitmaps merge, so they give exact counts of any
    grouping (``exact_stores``). Store ids are whole numbers; sales without a store count in no bitmap."""
    store = F.col("punto_venta_id")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), store.bitwiseAND(63).cast("int"))
    words = sales.groupBy(*GRAIN, F.shiftright("punto_venta_id", 6).alias("palabra")).agg(
        F.sum("monto").alias("monto"), F.sum("piezas").alias("piezas"), F.bit_or(bit).alias("bits")
    )
    filled = F.when(F.col("palabra").isNotNull(), F.struct("palabra", "bits"))
    # Words of one grain lie in many tasks: they are shuffled as rows, which are smaller than lists of one word.
    return words.repartition(*GRAIN).groupBy(*GRAIN).agg(
        F.sum("monto").alias("monto"),
        F.sum("piezas").alias("piezas"),
        F.sum(F.coalesce(F.bit_count("bits"), F.lit(0))).alias("pdvs"),
        F.sort_array(F.collect_list(filled)).alias("tiendas"),
    )


def stored_rollup(spark: SparkSession, path: str) -> VersionedTable:
    """The roll-up kept under ``path``: ``read()`` gives its current state."""
    return VersionedTable(spark, path, ("anio", "mes"))


def refresh_rollup(sales: DataFrame, path: str, start: int | None = None, end: int | None = None) -> int:
    """Recompute the months of a ``YYYYMM`` range in one commit: months of the range that have no sales any
    more leave the table with it, other months stay as they are. The number of the new state."""

    def inside(month: dict[str, str]) -> bool:
        number = int(month["anio"]) * 100 + int(month["mes"])
        return (start is None or number >= start) and (end is None or number <= end)

    return stored_rollup(sales.sparkSession, path).replace(monthly_rollup(between_months(sales, start, end)), inside)


def of_channel(rollup: DataFrame, channels: DataFrame, name: str | None) -> DataFrame:
    """Rows of one channel by name."""
    if name is None or name == "Todos":
        return rollup
    wanted = channels.where(F.col("nombre") == name).select(F.col("id").alias("canal_id"))
    return rollup.join(wanted, "canal_id", "left_semi")


def _rounded(c: str) -> Column:
    return half_up(F.col(c).cast("double"), 0).alias(c)


def _words(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """Store bitmaps merged per key: ``(*keys, palabra, bits)``."""
    each = rollup.select(*keys, F.explode("tiendas").alias("tienda"))
    return each.groupBy(*keys, F.col("tienda.palabra").alias("palabra")).agg(F.bit_or("tienda.bits").alias("bits"))


def _counted(words: DataFrame, keys: list[str]) -> DataFrame:
    merged = words.groupBy(*keys, "palabra").agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("pdv_distinct"))


def exact_stores(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, pdv_distinct)``: the stores of each group, each counted once, from the roll-up alone. Words are
    merged map-side; what is shuffled is a row per group and 64 stores."""
    return _words(rollup, keys).groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("pdv_distinct"))


def _with_stores(report: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    renamed = counts.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = report.join(renamed, same, "left").drop(*[f"_{k}" for k in keys])
    return joined.withColumn("pdv_distinct", F.coalesce("pdv_distinct", F.lit(0)))


def rollup_kpis(rollup: DataFrame, exact: bool = False) -> DataFrame:
    """One row per client; ``ticket_promedio`` divides by the summed store counts. With ``exact`` the
    exact store count and the ticket over it are added."""
    sums = rollup.groupBy("cliente_id").agg(
        amount("monto").alias("monto"),
        amount("piezas").alias("piezas"),
        total("pdvs").alias("pdv_activos"),
        F.countDistinct("producto_id").alias("productos_activos"),
    )
    added = []
    if exact:
        sums = _with_stores(sums, exact_stores(rollup, ["cliente_id"]), ["cliente_id"])
        added = ["pdv_distinct", half_up(ratio(F.col("monto"), F.col("pdv_distinct")), 0).alias("ticket_exacto")]
    return sums.select(
        *added,
        "cliente_id",
        half_up(F.col("monto"), 0).alias("monto_total"),
        half_up(F.col("piezas"), 0).alias("piezas_total"),
        "pdv_activos",
        "productos_activos",
        half_up(ratio(F.col("monto"), F.col("pdv_activos")), 0).alias("ticket_promedio"),
    )


def rollup_trend(rollup: DataFrame, exact: bool = False) -> DataFrame:
    """Per client and month; ``exact`` adds the exact store count."""
    keys = ["cliente_id", "anio", "mes"]
    sums = rollup.groupBy(*keys).agg(
        half_up(amount("monto"), 0).alias("monto"),
        half_up(amount("piezas"), 0).alias("piezas"),
        total("pdvs").alias("pdv"),
    )
    if exact:
        sums = _with_stores(sums, exact_stores(rollup, keys), keys)
    return sums.withColumn("periodo", period_text()).orderBy(*ascending(*keys))


def _named_stores(rollup: DataFrame, dim: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Bitmaps merged on the looked-up id, with the names put on."""
    return with_attributes(_words(rollup, [key]), dim, key, columns)


def _per_id(rollup: DataFrame, key: str) -> DataFrame:
    """Collapse on the lookup key before the name join."""
    return rollup.groupBy(key).agg(
        F.sum("monto").alias("monto"), F.sum("piezas").alias("piezas"), F.sum("pdvs").alias("pdvs")
    )


def _ranked_sums() -> list[Column]:
    return [
        half_up(amount("monto"), 0).alias("monto_total"),
        half_up(amount("piezas"), 0).alias("piezas_total"),
    ]


def top_products(
    rollup: DataFrame, products: DataFrame, n: int = RANKED, exact: bool = False
) -> DataFrame:
    """Largest products by name and brand; ``exact`` adds the exact store count."""
    named = with_attributes(
        _per_id(rollup, "producto_id"), products, "producto_id", {"nombre": "nombre", "marca": "marca"}
    )
    sums = named.groupBy("nombre", "marca").agg(*_ranked_sums(), total("pdvs").alias("pdv"))
    labelled = sums.withColumn("producto", or_default("nombre", "Sin nombre"))
    best, added = top(labelled, "monto_total", ["producto", "marca"], n), []
    if exact:
        # Stores are not ranked by: those of the listed products are enough. A product without any keeps its row.
        each = with_attributes(rollup.select("producto_id", "tiendas"), products, "producto_id", {"_nombre": "nombre", "_marca": "marca"})
        listed = [F.col("_nombre").eqNullSafe(F.col("nombre")), F.col("_marca").eqNullSafe(F.col("marca"))]
        stores = each.join(best, listed).select(*best.columns, F.explode_outer("tiendas").alias("tienda"))
        words = stores.groupBy(*best.columns, F.col("tienda.palabra").alias("palabra")).agg(F.bit_or("tienda.bits").alias("bits"))
        counted = words.groupBy(*best.columns).agg(total(F.bit_count("bits")).alias("pdv_distinct"))
        best, added = top(counted, "monto_total", ["producto", "marca"], n), ["pdv_distinct"]
    return best.select("producto", "marca", "monto_total", "piezas_total", "pdv", *added)


def top_chains(
    rollup: DataFrame, chains: DataFrame, n: int = RANKED, exact: bool = False
) -> DataFrame:
    """Largest chains by report name; ``exact`` adds the exact store count."""
    named = with_attributes(_per_id(rollup, "cadena_id"), chains, "cadena_id", {"nombre": "nombre"})
    sums = named.groupBy(report_chain("nombre").alias("cadena")).agg(
        *_ranked_sums(), total("pdvs").alias("pdv")
    )
    if exact:
        stores = _named_stores(rollup, chains, "cadena_id", {"nombre": "nombre"})
        stores = stores.withColumn("cadena", report_chain("nombre"))
        sums = _with_stores(sums, _counted(stores, ["cadena"]), ["cadena"])
    return top(sums, "monto_total", ["cadena"], n)


def channel_mix(rollup: DataFrame, channels: DataFrame) -> DataFrame:
    named = with_attributes(
        _per_id(rollup, "canal_id"), channels, "canal_id", {"canal": "nombre", "segmento": "segmento"}
    )
    return (
        named.groupBy("canal", "segmento")
        .agg(*_ranked_sums())
        .select(
            or_default("canal", "Sin canal").alias("canal"),
            or_default("segmento", "Sin segmento").alias("segmento"),
            "monto_total",
            "piezas_total",
        )
        .orderBy(*descending("monto_total"), "canal", "segmento")
    )


def same_month_by_year(rollup: DataFrame, month: int) -> DataFrame:
    return (
        rollup.where(F.col("mes") == month)
        .groupBy("anio")
        .agg(half_up(amount("monto"), 0).alias("monto"), half_up(amount("piezas"), 0).alias("piezas"))
        .orderBy("anio")
    )


def channel_options(rollup: DataFrame, channels: DataFrame) -> DataFrame:
    """Names of the channels that have sales, per client."""
    used = rollup.select("cliente_id", "canal_id").distinct()
    names = unique_by_id(channels).select(F.col("id").alias("canal_id"), "nombre")
    return used.join(names, "canal_id").select("cliente_id", "nombre").distinct().orderBy("cliente_id", "nombre")
