"""Check-in distance and its classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina.functions.numbers import ColumnLike, as_column

# Metres per degree of latitude, default thresholds, class names.
METRES_PER_DEGREE = 111_320.0
AMBER_METRES = 300
RED_METRES = 1_000
IN_RANGE = "En rango"
ALERT = "Alerta"
CRITICAL = "Crítico"
UNKNOWN = "Sin dato"


def distance_metres(lat: ColumnLike, lon: ColumnLike, ref_lat: ColumnLike, ref_lon: ColumnLike) -> Column:
    """Equirectangular distance in whole metres; NULL when a coordinate is NULL or NaN."""
    lat, lon, ref_lat, ref_lon = map(as_column, (lat, lon, ref_lat, ref_lon))
    north = lat - ref_lat
    east = (lon - ref_lon) * F.cos(F.radians(ref_lat))
    metres = F.round(F.sqrt(F.pow(north, 2) + F.pow(east, 2)) * F.lit(METRES_PER_DEGREE), 0)
    return F.when(~F.isnan(metres), metres)


def distance_class(metres: ColumnLike, amber: float = AMBER_METRES, red: float = RED_METRES) -> Column:
    metres = as_column(metres)
    return (
        F.when(metres.isNull() | F.isnan(metres), UNKNOWN)
        .when(metres <= amber, IN_RANGE)
        .when(metres <= red, ALERT)
        .otherwise(CRITICAL)
    )


def usable(coordinate: ColumnLike) -> Column:
    coordinate = as_column(coordinate)
    return coordinate.isNotNull() & ~F.isnan(coordinate)
