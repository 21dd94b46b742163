"""Raw event table -> time features, place features, and both joined on the event id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from hexcadence.operators import clean, geo, relational, timebin

# Default part columns, cyclic parts and cell resolutions.
TIME_PARTS = ("year", "month", "week", "weekday", "day", "hour", "minute", "is_weekend")
CYCLIC_PARTS = ("month", "week", "weekday", "day", "hour")
RESOLUTIONS = (4, 5, 6, 7, 8, 9, 10)


def time_features(
    events: DataFrame,
    key: str,
    *,
    timestamp: str | None = None,
    id_col: str | None = None,
    time_text: str = "hr_min",
    parts: Sequence[str] = TIME_PARTS,
    cyclic: Sequence[str] = CYCLIC_PARTS,
) -> DataFrame:
    """Key, ``datetime``, its parts and their cyclic encodings.

    The timestamp is a given column, or is built from date parts, id year and clock text.
    """
    if timestamp is not None:
        stamped = events.withColumnRenamed(timestamp, "datetime")
    else:
        stamped = timebin.with_timestamp(events, id_col=id_col, time_text=time_text)
    encoded = timebin.with_cyclic(
        timebin.with_time_parts(stamped.select(key, "datetime"), "datetime", parts), cyclic
    )
    return encoded


def place_features(
    events: DataFrame,
    key: str,
    lat: str,
    lon: str,
    *,
    region: str | None = None,
    resolutions: Sequence[int] = RESOLUTIONS,
    repair: bool = True,
) -> DataFrame:
    """Key, coordinates in degrees and cells at all resolutions.

    ``repair`` takes scaled degrees (the default damage); otherwise projected metres are converted.
    """
    df = clean.exclude_regions(events, region) if region else events
    if repair:
        fixed = geo.repair_scale(df, lat, lon, "latitude_convert", "longitude_convert")
    else:
        fixed = geo.to_degrees(geo.classify_coordinates(df, lat, lon), lat, lon, suffix="").withColumnsRenamed(
            {lat: "latitude_convert", lon: "longitude_convert"}
        )
    narrow = fixed.select(key, "latitude_convert", "longitude_convert")
    return geo.with_cells(narrow, "latitude_convert", "longitude_convert", resolutions)


def event_features(times: DataFrame, places: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Events that have both a time and a place."""
    return relational.join_all([places, times], [key]).select(*columns)
