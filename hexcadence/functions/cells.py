"""Hexagonal cells as Column expressions.

Equal-area cylindrical projection, hexagons of edge ``EDGE_RES0_KM / sqrt(7)**res``, axial
coordinates by cube rounding.  A cell is carried as ``struct<q, r>`` while it is computed and as
text ``res:q:r`` once it is a column of a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the grid.
EARTH_RADIUS_KM = 6371.0088
STANDARD_LATITUDE = 46.5
EDGE_RES0_KM = 200.0


def edge_km(res: int) -> float:
    return EDGE_RES0_KM / math.pow(math.sqrt(7.0), res)


def plane_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Kilometres east and north on the equal-area cylinder."""
    scale = math.cos(math.radians(STANDARD_LATITUDE))
    x = F.lit(EARTH_RADIUS_KM) * F.radians(lon) * F.lit(scale)
    y = F.lit(EARTH_RADIUS_KM) * F.sin(F.radians(lat)) / F.lit(scale)
    return x, y


def fractional_axial(x: Column, y: Column, res: int) -> tuple[Column, Column]:
    e = F.lit(edge_km(res))
    q = (F.lit(math.sqrt(3.0) / 3) * x - y / F.lit(3.0)) / e
    r = (F.lit(2.0 / 3.0) * y) / e
    return q, r


def with_nearest_cell(df: DataFrame, q: Column, r: Column, out: str) -> DataFrame:
    """Add ``out: struct<q, r>``, the nearest hexagon centre of fractional axial coordinates.

    The steps are separate projections, and the result passes through a one-element ``explode``:
    without that barrier a filter on a coarse cell would be rewritten into one expression over all
    finer levels, which grows exponentially.
    """
    half = F.lit(0.5)
    fq, fr = F.col("_fq"), F.col("_fr")
    staged = df.withColumns({"_fq": q, "_fr": r}).withColumns(
        {"_rq": F.floor(fq + half), "_rr": F.floor(fr + half), "_rs": F.floor(-fq - fr + half)}
    )
    rq, rr, rs = F.col("_rq"), F.col("_rr"), F.col("_rs")
    staged = staged.withColumns(
        {"_dq": F.abs(rq - fq), "_dr": F.abs(rr - fr), "_ds": F.abs(rs + fq + fr)}
    )
    dq, dr, ds = F.col("_dq"), F.col("_dr"), F.col("_ds")
    q_worst = (dq > dr) & (dq > ds)
    new_q = F.when(q_worst, -rr - rs).otherwise(rq).cast("bigint")
    new_r = F.when(~q_worst & (dr > ds), -rq - rs).otherwise(rr).cast("bigint")
    # Coordinates are known here; saying so lets later "is not null" filters fold away.
    nearest = F.struct(
        F.coalesce(new_q, F.lit(0)).alias("q"), F.coalesce(new_r, F.lit(0)).alias("r")
    )
    keep = [c for c in df.columns if c != out]
    return staged.select(*keep, F.explode(F.array(nearest)).alias(out))


def centre_xy(cell: Column, res: int) -> tuple[Column, Column]:
    q, r = cell["q"].cast("double"), cell["r"].cast("double")
    e = edge_km(res)
    return F.lit(e * math.sqrt(3.0)) * (q + r / F.lit(2.0)), F.lit(e * 1.5) * r


def cell_text(cell: Column, res: int) -> Column:
    return F.concat(F.lit(f"{res}:"), cell["q"].cast("string"), F.lit(":"), cell["r"].cast("string"))


def axial_of(cell_id: Column | str) -> tuple[Column, Column, Column]:
    """Resolution, q and r of a cell text."""
    c = F.col(cell_id) if isinstance(cell_id, str) else cell_id
    part = [F.split_part(c, F.lit(":"), F.lit(i)) for i in (1, 2, 3)]
    return part[0].cast("int"), part[1].cast("bigint"), part[2].cast("bigint")


def ring_offsets(k: int, include_centre: bool = False) -> list[tuple[int, int]]:
    """Axial steps to every cell within distance ``k`` (3k(k+1) of them, plus the centre)."""
    span = range(-k, k + 1)
    steps = [(dq, dr) for dq in span for dr in span if abs(dq + dr) <= k]
    return [s for s in steps if include_centre or s != (0, 0)]


def boundary(res: Column, q: Column, r: Column) -> Column:
    """Six corners of a cell as ``array<struct<lon, lat>>``."""
    scale = math.cos(math.radians(STANDARD_LATITUDE))
    e = F.lit(EDGE_RES0_KM) / F.pow(F.lit(math.sqrt(7.0)), res)
    cx = e * F.lit(math.sqrt(3.0)) * (q + r / F.lit(2.0))
    cy = e * F.lit(1.5) * r
    corners = []
    for i in range(6):
        angle = math.radians(60 * i - 30)
        x, y = cx + e * F.lit(math.cos(angle)), cy + e * F.lit(math.sin(angle))
        lon = F.degrees(x / F.lit(EARTH_RADIUS_KM * scale))
        lat = F.degrees(F.asin(y * F.lit(scale / EARTH_RADIUS_KM)))
        corners.append(F.struct(lon.alias("lon"), lat.alias("lat")))
    return F.array(*corners)
