"""Events -> count cube -> dense grid -> features, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hexcadence.operators import cube, timebin, windows


def feature_table(
    events: DataFrame,
    cell: str,
    ts: str,
    freq: str,
    *,
    target: str = "has_event",
    min_events: int = 2,
    calendar: str = "observed",
    lags=windows.LAGS,
    rolls=windows.ROLLS,
    stats=windows.ROLL_STATS,
    cyclic: bool = False,
) -> DataFrame:
    """Feature table (cell, time_bin, n, has_event, lags, rolls, streaks) of an event table.

    Features are taken from ``target`` (``has_event`` or ``n``).
    """
    binned = timebin.with_bin(events, ts, freq)
    counts = cube.count_cube(binned, cell, "time_bin")
    grid = cube.densify(
        counts, cell, "time_bin", "n", freq, min_events=min_events, calendar=calendar
    )
    table = windows.ts_features(
        cube.with_target(grid, "n"), cell, "time_bin", target, lags, rolls, stats
    )
    return timebin.with_bin_cycle(table, "time_bin", freq) if cyclic else table
