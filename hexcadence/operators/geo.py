"""Coordinate classification, repair and reprojection; hex cells and their geometry."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexcadence.functions import cells as C


@dataclass(frozen=True)
class Box:
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float

    def holds(self, lat: Column, lon: Column) -> Column:
        return lat.between(self.lat_min, self.lat_max) & lon.between(self.lon_min, self.lon_max)


# Boxes of plausible coordinates.
DEGREE_BOX = Box(lat_min=41.0, lat_max=52.0, lon_min=-6.0, lon_max=10.0)
PROJECTED_BOX = Box(lat_min=4000000.0, lat_max=5500000.0, lon_min=-500000.0, lon_max=1500000.0)
REPAIR_BOX = Box(lat_min=40.0, lat_max=52.0, lon_min=-6.0, lon_max=11.0)
REPAIR_SCALES = (1.0, 1e5, 1e6)
COORD_CLASSES = (
    "missing",
    "wgs84",
    "lambert93_like",
    "swapped_wgs84",
    "swapped_lambert93",
    "invalid",
)


def _num(c: str) -> Column:
    """Number of a column of any type; text that is no number, and NaN, are null."""
    return F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))


def coord_class(
    lat: Column, lon: Column, degrees: Box = DEGREE_BOX, projected: Box = PROJECTED_BOX
) -> Column:
    return (
        F.when(lat.isNull() | lon.isNull(), "missing")
        .when(degrees.holds(lat, lon), "wgs84")
        .when(projected.holds(lat, lon), "lambert93_like")
        .when(degrees.holds(lon, lat), "swapped_wgs84")
        .when(projected.holds(lon, lat), "swapped_lambert93")
        .otherwise("invalid")
    )


def classify_coordinates(
    df: DataFrame, lat: str, lon: str, degrees: Box = DEGREE_BOX, projected: Box = PROJECTED_BOX
) -> DataFrame:
    return df.withColumn("coord_class", coord_class(_num(lat), _num(lon), degrees, projected))


def quality_report(df: DataFrame) -> DataFrame:
    """Rows per coordinate class with share of all rows."""
    counts = df.groupBy("coord_class").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # six rows at most
    share = F.col("count") / F.col("total")
    return (
        counts.withColumn("total", total)
        .withColumn("share", share)
        .withColumn("share_percent", F.round(F.col("share") * 100, 2))
        .orderBy(F.desc("count"), "coord_class")
    )


def sample_by_class(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First ``n`` rows of each class in key order (a partial limit runs before the shuffle)."""
    w = Window.partitionBy("coord_class").orderBy(key)
    return df.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= n)


@dataclass(frozen=True)
class Conic:
    """Lambert conformal conic with two standard parallels (public EPSG parameters)."""

    semi_major: float
    flattening_inv: float
    lat0: float
    lon0: float
    lat1: float
    lat2: float
    false_east: float
    false_north: float

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude in degrees."""
        f = 1.0 / self.flattening_inv
        ecc = math.sqrt(2 * f - f * f)

        def m(lat: float) -> float:
            return math.cos(lat) / math.sqrt(1 - (ecc * math.sin(lat)) ** 2)

        def t(lat: float) -> float:
            es = ecc * math.sin(lat)
            return math.tan(math.pi / 4 - lat / 2) / ((1 - es) / (1 + es)) ** (ecc / 2)

        l0, l1, l2 = (math.radians(v) for v in (self.lat0, self.lat1, self.lat2))
        n = (math.log(m(l1)) - math.log(m(l2))) / (math.log(t(l1)) - math.log(t(l2)))
        big_f = m(l1) / (n * t(l1) ** n)
        rho0 = self.semi_major * big_f * t(l0) ** n

        east = x - F.lit(self.false_east)
        north = F.lit(rho0) - (y - F.lit(self.false_north))
        rho = F.sqrt(east * east + north * north)
        tt = F.pow(rho / F.lit(self.semi_major * big_f), F.lit(1.0 / n))
        chi = F.lit(math.pi / 2) - F.lit(2.0) * F.atan(tt)
        # Latitude from the conformal latitude: the closed series in sin(2 chi), sin(4 chi), ...
        # (fixed order e^8) keeps the expression flat where an iteration would nest.
        e2, e4, e6, e8 = ecc**2, ecc**4, ecc**6, ecc**8
        series = [
            (2, e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360),
            (4, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520),
            (6, 7 * e6 / 120 + 81 * e8 / 1120),
            (8, 4279 * e8 / 161280),
        ]
        lat = reduce(lambda acc, k: acc + F.lit(k[1]) * F.sin(F.lit(float(k[0])) * chi), series, chi)
        lon = F.atan2(east, north) / F.lit(n) + F.lit(math.radians(self.lon0))
        return F.degrees(lon), F.degrees(lat)


# Parameters of EPSG:2154.
LAMBERT_93 = Conic(
    semi_major=6378137.0,
    flattening_inv=298.257222101,
    lat0=46.5,
    lon0=3.0,
    lat1=44.0,
    lat2=49.0,
    false_east=700000.0,
    false_north=6600000.0,
)


def to_degrees(
    df: DataFrame,
    lat: str,
    lon: str,
    suffix: str = "convert",
    invalid: str | None = None,
    projection: Conic = LAMBERT_93,
) -> DataFrame:
    """Degrees for every class: reproject, swap, keep, or null.

    ``invalid``: ``"drop"`` removes invalid rows, otherwise their result is null.
    """
    la, lo = _num(lat), _num(lon)
    cls = F.col("coord_class")
    swapped = cls == "swapped_lambert93"
    x, y = F.when(swapped, la).otherwise(lo), F.when(swapped, lo).otherwise(la)
    lon_p, lat_p = projection.inverse(x, y)
    projected = cls.isin("lambert93_like", "swapped_lambert93")
    out_lat = F.when(projected, lat_p).when(cls == "wgs84", la).when(cls == "swapped_wgs84", lo)
    out_lon = F.when(projected, lon_p).when(cls == "wgs84", lo).when(cls == "swapped_wgs84", la)
    tail = f"_{suffix}" if suffix else ""
    out = df.withColumns({f"{lat}{tail}": out_lat, f"{lon}{tail}": out_lon})
    return out.where(cls != "invalid") if invalid == "drop" else out


def repair_scale(
    df: DataFrame,
    lat: str,
    lon: str,
    out_lat: str = "lat_norm",
    out_lon: str = "lon_norm",
    box: Box = REPAIR_BOX,
    scales: Sequence[float] = REPAIR_SCALES,
) -> DataFrame:
    """First scale that puts both coordinates into the box; null when none does."""
    la, lo = _num(lat), _num(lon)
    tries = [
        F.when(
            box.holds(la / F.lit(s), lo / F.lit(s)),
            F.struct((la / F.lit(s)).alias("lat"), (lo / F.lit(s)).alias("lon")),
        )
        for s in scales
    ]
    # The one-element explode keeps the three tries from being copied into every later use.
    fixed = df.withColumn("_fixed", F.explode(F.array(F.coalesce(*tries))))
    return fixed.withColumns(
        {out_lat: F.col("_fixed.lat"), out_lon: F.col("_fixed.lon")}
    ).drop("_fixed")


def with_cells(
    df: DataFrame, lat: str, lon: str, resolutions: Sequence[int], prefix: str = "cell_res"
) -> DataFrame:
    """Cell at the finest resolution and, from its centre upward, every coarser parent.

    Rows without both coordinates are left out.
    """
    levels = sorted(set(resolutions), reverse=True)
    la, lo = _num(lat), _num(lon)
    out = df.where(la.isNotNull() & lo.isNotNull())
    q, r = C.fractional_axial(*C.plane_xy(la, lo), levels[0])
    out = C.with_nearest_cell(out, q, r, f"_c{levels[0]}")
    for child, parent in zip(levels, levels[1:]):
        q, r = C.fractional_axial(*C.centre_xy(F.col(f"_c{child}"), child), parent)
        out = C.with_nearest_cell(out, q, r, f"_c{parent}")
    out = out.withColumns({f"{prefix}{n}": C.cell_text(F.col(f"_c{n}"), n) for n in levels})
    return out.drop(*[f"_c{n}" for n in levels])


def parent_cell(df: DataFrame, cell: str, child_res: int, parent_res: int, out: str) -> DataFrame:
    """Parent of a cell column, found from the child's centre; rows without a cell are left out."""
    _, q, r = C.axial_of(cell)
    cx, cy = C.centre_xy(F.struct(q.alias("q"), r.alias("r")), child_res)
    known = df.where(F.col(cell).isNotNull())
    found = C.with_nearest_cell(known, *C.fractional_axial(cx, cy, parent_res), "_c")
    return found.withColumn(out, C.cell_text(F.col("_c"), parent_res)).drop("_c")


def with_boundary(df: DataFrame, cell: str, out: str = "boundary") -> DataFrame:
    return df.withColumn(out, C.boundary(*C.axial_of(cell)))


def neighbours(df: DataFrame, cell: str, k: int = 1, out: str = "neighbour") -> DataFrame:
    """One row per cell within ``k`` steps (bounded: 3k(k+1) per input row)."""
    res, q, r = C.axial_of(cell)
    steps = F.array(
        *[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in C.ring_offsets(k)]
    )
    moved = df.withColumn("_step", F.explode(steps))
    text = F.concat_ws(":", res, q + F.col("_step.dq"), r + F.col("_step.dr"))
    return moved.withColumn(out, text).drop("_step")


def duplicate_coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows whose coordinate pair was seen before, and their ratio (nulls count as equal)."""
    pairs = df.groupBy(lat, lon).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.agg(
        F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_duplicates")
    ).select(
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_duplicates", F.lit(0)).alias("n_duplicates"),
        F.try_divide("n_duplicates", "n_rows").alias("duplicate_ratio"),
    )


def range_check(df: DataFrame, lat: str, lon: str) -> DataFrame:
    la, lo = _num(lat), _num(lon)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~la.between(-90, 90)).alias("lat_out_of_range"),
        F.count_if(~lo.between(-180, 180)).alias("lon_out_of_range"),
    )


def geo_share(df: DataFrame, lat: str, lon: str) -> DataFrame:
    both = _num(lat).isNotNull() & _num(lon).isNotNull()
    return df.agg(F.avg(both.cast("int")).alias("geo_ratio"))


def map_layer(long_cube: DataFrame, res: str, cell: str, value: str) -> DataFrame:
    """Total per cell with log1p, the largest total overall and per resolution."""
    totals = long_cube.groupBy(res, cell).agg(F.sum(value).alias("total"))
    per_res = totals.groupBy(res).agg(F.max("total").alias("max_in_resolution"))
    overall = per_res.select(F.max("max_in_resolution")).scalar()
    # One row per resolution.
    return (
        totals.withColumn("log_total", F.log1p("total"))
        .join(F.broadcast(per_res), res)
        .withColumn("max_overall", overall)
    )


def geojson_features(df: DataFrame, res: str, cell: str, value: str) -> DataFrame:
    """One GeoJSON feature text per cell; the ring is closed by its first corner."""
    ring = F.transform(C.boundary(*C.axial_of(cell)), lambda p: F.array(p["lon"], p["lat"]))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    props = F.struct(
        F.col(cell).alias("cell"), F.col(value).alias("value"), F.col(res).alias("resolution")
    )
    feature = F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")
    )
    return df.select(F.col(cell), F.to_json(feature).alias("feature"))


def rollup_check(child: DataFrame, parent: DataFrame, parent_col: str, value: str) -> DataFrame:
    """Sum of children per parent against the stored parent value."""
    sums = child.groupBy(parent_col).agg(F.sum(value).alias("child_sum"))
    stored = parent.select(parent_col, F.col(value).alias("parent_value"))
    return sums.join(stored, parent_col, "full_outer").withColumn(
        "difference",
        F.coalesce("child_sum", F.lit(0)) - F.coalesce("parent_value", F.lit(0)),
    )


def detect_geo_columns(columns: Sequence[str]) -> dict[str, list[str]]:
    """Latitude, longitude and combined coordinate columns by name."""
    low = {c: c.lower() for c in columns}
    return {
        "lat": [c for c in columns if "lat" in low[c]],
        "lon": [c for c in columns if "lon" in low[c] or "lng" in low[c]],
        "gps": [c for c in columns if "gps" in low[c]],
    }
