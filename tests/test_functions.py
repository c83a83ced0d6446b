import math

import pytest
from pyspark.sql import functions as F

from vitrina.functions import clock, geo, labels, numbers, text
from vitrina.functions.place_names import MUNICIPALITIES, STATES


@pytest.fixture
def of(spark):
    """Values of a Column over one input column ``x``."""

    def run(values, kind, *columns):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
        out = [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]
        return [r[0] for r in out] if len(columns) == 1 else out

    return run


def test_rounding_modes(of):
    halves = [0.5, 1.5, 2.5, -0.5, None]
    assert of(halves, "DOUBLE", numbers.half_even(F.col("x"))) == [0.0, 2.0, 2.0, 0.0, None]
    assert of(halves, "DOUBLE", numbers.half_up(F.col("x"))) == [1.0, 2.0, 3.0, -1.0, None]
    assert of([1.25, 0.35, 2.675], "DOUBLE", numbers.half_even(F.col("x"), 1)) == [1.2, 0.4, 2.7]
    assert of([1.005, 2.5], "DOUBLE", numbers.half_up(F.col("x"), 2)) == [1.0, 2.5]


def test_percent(of):
    assert of([0, 4, None], "INT", numbers.percent(F.lit(1), "x")) == [None, 25.0, None]
    assert of([0, 4], "INT", numbers.percent(F.lit(1), "x", empty=0.0)) == [0.0, 25.0]


def test_clock(of):
    assert of([0.0, 30600.0, 86399.9, None], "DOUBLE", clock.hhmm("x")) == ["00:00", "08:30", "23:59", None]
    assert of(["08:30", "8:30", "ab:cd", None], "STRING", clock.minutes_of("x")) == [510, None, None, None]
    moment = F.col("x").cast("timestamp_ntz")
    assert of(["2024-01-02 08:15:00.000001"], "STRING", clock.micros_of_day(moment)) == [29_700_000_001]
    assert of(["2024-01-02 08:15:59"], "STRING", clock.clock_text(moment)) == ["08:15"]
    assert of(["2024-01-02"], "STRING", clock.date_text(F.col("x").cast("date"))) == ["02/01/2024"]


def test_durations_ignore_the_session_zone(spark, of):
    span = clock.micros_between(
        F.lit("2024-03-10 01:30:00").cast("timestamp_ntz"), F.col("x").cast("timestamp_ntz")
    )
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert of(["2024-03-10 03:30:00", "2024-03-10 01:00:00"], "STRING", span) == [7_200_000_000, -1_800_000_000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_calendar(spark):
    df = spark.createDataFrame([("2021-01-03",), ("2024-12-30",), (None,)], "d STRING")
    rows = clock.with_calendar(df.withColumn("d", F.col("d").cast("date")), "d", week=True, day_name=True).collect()
    assert [tuple(r)[1:] for r in rows] == [(2021, 1, 53, "Sunday"), (2024, 12, 1, "Monday"), (None,) * 4]


def test_text_repair(of):
    assert of(["JosÃ© GarcÃ­a", "CancÃºn ÃÂº Ã±", "Ãlvaro", "Â¡ya!", "llano", None], "STRING", text.repair_text("x")) == [
        "José García",
        "Cancún ú ñ",
        "Álvaro",
        "¡ya!",
        "llano",
        None,
    ]


def test_chain_names(of):
    raw = [" walmart ", "SAMS", "sams club", "nan", "NAN", "", None, " Tiendita ", "7 eleven"]
    assert of(raw, "STRING", text.report_chain("x"), text.clean_chain("x")) == [
        ("Walmart", "Walmart"),
        ("Sam's Club", "Sam's Club"),
        ("Sam's Club", "Sam's Club"),
        ("Sin cadena", None),
        ("Sin cadena", "NAN"),
        ("Sin cadena", None),
        ("Sin cadena", None),
        ("Tiendita", "Tiendita"),
        ("7 eleven", "7-Eleven"),
    ]


def test_place_names(of):
    states = ["BCS", "CDMX", "Nuevo LeÃ³n", "09", "12345", "S/A", "nan", "", None, " Puebla ", "MX"]
    assert of(states, "STRING", text.clean_state("x")) == [
        "Baja California Sur",
        "Ciudad de México",
        "Nuevo León",
        None,
        None,
        None,
        None,
        None,
        None,
        "Puebla",
        None,
    ]
    towns = ["LEON", "CuauhtÃ©moc", "S/A", None, "12", " Los cabos"]
    assert of(towns, "STRING", text.clean_municipality("x")) == ["León", "Cuauhtémoc", None, None, "12", "Los Cabos"]


def test_normalisers_are_idempotent(of):
    once = of(list(STATES), "STRING", text.clean_state("x"))
    assert once == list(STATES.values())
    assert of(once, "STRING", text.clean_state("x")) == ["Estado de México" if s == "México" else s for s in once]
    towns = of(list(MUNICIPALITIES), "STRING", text.clean_municipality("x"))
    assert towns == list(MUNICIPALITIES.values())
    assert of(towns, "STRING", text.clean_municipality("x")) == towns


def test_distance_and_class(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(19.0, -99.0, 19.0, -99.0), (19.0027, -99.0, 19.0, -99.0), (19.005, -99.0, 19.0, -99.0),
         (19.02, -99.02, 19.0, -99.0), (nan, -99.0, 19.0, -99.0), (None, -99.0, 19.0, -99.0)],
        "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE",
    )
    metres = geo.distance_metres("a", "b", "c", "d").alias("m")
    rows = df.select(metres).select("m", geo.distance_class("m")).collect()
    far = round(111320 * math.hypot(0.02, 0.02 * math.cos(math.radians(19))))
    assert [tuple(r) for r in rows] == [
        (0.0, "En rango"),
        (301.0, "Alerta"),
        (557.0, "Alerta"),
        (float(far), "Crítico"),
        (None, "Sin dato"),
        (None, "Sin dato"),
    ]


def test_bins(of):
    values = [None, -1.0, -0.5, 0.0, 0.1, 5.0, 15.0, 15.1, 100.0, 100.1]
    assert of(values, "DOUBLE", labels.binned("x", labels.STOCKOUT_BINS)) == [
        "Sin quiebre", None, "Sin quiebre", "Sin quiebre", "Bajo", "Bajo", "Medio", "Alto", "Alto", None,
    ]
    assert of([0.0, 49.0, 49.5, 79.0, 80.0, 101.0], "DOUBLE", labels.binned("x", labels.PLANOGRAM_BINS)) == [
        "Bajo", "Bajo", "Medio", "Medio", "Alto", None,
    ]


def test_flags_and_levels(of):
    marks = ["1", "0x01", "True", "true", "0", "0x00", "False", "x", None]
    assert of(marks, "STRING", labels.bit("x")) == [True] * 4 + [False] * 3 + [None] * 2
    assert of([80.0, 79.9, None, float("nan")], "DOUBLE", labels.at_least("x", 80)) == [True, False, False, False]
    assert of([80, 60, 59, None], "INT", labels.level("x", labels.VISIT_LEVELS)) == ["green", "yellow", "red", "red"]
    assert of([11, 10, 5, None], "INT", labels.level("x", labels.STOCKOUT_LEVELS, False)) == ["red", "yellow", "green", "green"]
    assert of([0, 1, 7], "INT", labels.workday_event("x")) == ["Check-in", "Check-out", "7"]
    assert of([True, False, None], "BOOLEAN", labels.price_kind_or_unknown("x")) == ["Propio", "Competencia", "Sin dato"]
    assert of(["PRC012", "PRC112", "PRC0123", None], "STRING", labels.is_supervisor("x")) == [True, False, False, False]
