"""Queries on coordinates and hex cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hexcadence.functions import cells as C
from hexcadence.operators import clusters, geo
from hexcadence.workload.base import BROKEN_EVENTS, PLACED_EVENTS, broken_events, placed_events, query, table

_SCALE = math.cos(math.radians(C.STANDARD_LATITUDE))


def _axial_sql(x: str, y: str, res: int) -> str:
    e = C.edge_km(res)
    return (
        f"({math.sqrt(3.0) / 3!r} * {x} - {y} / 3e0) / {e!r} AS q, "
        f"({2.0 / 3.0!r} * {y}) / {e!r} AS r"
    )


def _round_sql(source: str, res: int) -> str:
    """Cube rounding of columns q, r of ``source`` into integer columns q{res}, r{res}."""
    return f"""
    SELECT * EXCLUDE (q, r, rq, rr, rs, dq, dr, ds),
      CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q{res},
      CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r{res}
    FROM (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds
          FROM (SELECT *, floor(q + 0.5e0) AS rq, floor(r + 0.5e0) AS rr, floor(-q - r + 0.5e0) AS rs
                FROM ({source}) AS s0) AS s1) AS s2
    """


def cells_sql(resolutions, source: str = PLACED_EVENTS, lat: str = "lat", lon: str = "lon") -> str:
    """SQL of ``geo.with_cells``."""
    levels = sorted(resolutions, reverse=True)
    x = f"({C.EARTH_RADIUS_KM!r} * radians({lon}) * {_SCALE!r})"
    y = f"({C.EARTH_RADIUS_KM!r} * sin(radians({lat})) / {_SCALE!r})"
    sql = _round_sql(
        f"SELECT *, {_axial_sql(x, y, levels[0])} FROM ({source}) AS src WHERE {lat} IS NOT NULL AND {lon} IS NOT NULL",
        levels[0],
    )
    for child, parent in zip(levels, levels[1:]):
        e = C.edge_km(child)
        cx = f"({e * math.sqrt(3.0)!r} * (CAST(q{child} AS DOUBLE) + CAST(r{child} AS DOUBLE) / 2e0))"
        cy = f"({e * 1.5!r} * CAST(r{child} AS DOUBLE))"
        sql = _round_sql(f"SELECT *, {_axial_sql(cx, cy, parent)} FROM ({sql}) AS child", parent)
    ids = ", ".join(f"concat('{n}:', q{n}, ':', r{n}) AS cell_res{n}" for n in levels)
    return f"SELECT *, {ids} FROM ({sql}) AS cells"


_D, _P = geo.DEGREE_BOX, geo.PROJECTED_BOX


def _holds(box, lat, lon):
    return (
        f"({lat} BETWEEN {box.lat_min!r} AND {box.lat_max!r} AND {lon} BETWEEN {box.lon_min!r} AND {box.lon_max!r})"
    )


_CLASS = f"""CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'missing'
  WHEN {_holds(_D, 'latitude', 'longitude')} THEN 'wgs84'
  WHEN {_holds(_P, 'latitude', 'longitude')} THEN 'lambert93_like'
  WHEN {_holds(_D, 'longitude', 'latitude')} THEN 'swapped_wgs84'
  WHEN {_holds(_P, 'longitude', 'latitude')} THEN 'swapped_lambert93' ELSE 'invalid' END"""
_CLASSIFIED = f"SELECT *, {_CLASS} AS coord_class FROM ({BROKEN_EVENTS}) AS b"


def classified(spark, d):
    return geo.classify_coordinates(broken_events(spark, d), "latitude", "longitude")


@query("coordinate_classes", "event_id:i coord_class:s", _CLASSIFIED)
def coordinate_classes(spark, d):
    return classified(spark, d)


@query(
    "coordinate_quality_report",
    "coord_class:s total:i count:i share:d share_percent:d2",
    f"""
    SELECT coord_class, CAST(sum(count(*)) OVER () AS BIGINT) AS total, count(*) AS count,
      count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share,
      100 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share_percent
    FROM ({_CLASSIFIED}) AS c GROUP BY 1
    """,
)
def coordinate_quality_report(spark, d):
    return geo.quality_report(classified(spark, d))


@query(
    "coordinate_samples",
    "coord_class:s event_id:i latitude:d longitude:d sample_no:i",
    f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coord_class ORDER BY event_id) AS sample_no
      FROM ({_CLASSIFIED}) AS c) AS t WHERE sample_no <= 5
    """,
)
def coordinate_samples(spark, d):
    return geo.sample_by_class(classified(spark, d), "event_id", 5)


# True projected coordinates for the reprojection: metres around the origin of the projection.
_METRES = """
  SELECT event_id, 100000e0 + event_id * 7919 % 1100000 AS mx, 6050000e0 + event_id * 104729 % 1000000 AS my,
    event_id % 5 AS kind FROM events
"""
_METRE_BOX = geo.Box(lat_min=6000000.0, lat_max=7200000.0, lon_min=0.0, lon_max=1300000.0)


def _inverse_sql(x: str, y: str) -> tuple[str, str]:
    """Inverse conic by the fixed-point iteration on the latitude (six rounds)."""
    p = geo.LAMBERT_93
    f = 1 / p.flattening_inv
    ecc = math.sqrt(2 * f - f * f)
    l0, l1, l2 = (math.radians(v) for v in (p.lat0, p.lat1, p.lat2))
    m = lambda a: math.cos(a) / math.sqrt(1 - (ecc * math.sin(a)) ** 2)
    t = lambda a: math.tan(math.pi / 4 - a / 2) / ((1 - ecc * math.sin(a)) / (1 + ecc * math.sin(a))) ** (ecc / 2)
    n = (math.log(m(l1)) - math.log(m(l2))) / (math.log(t(l1)) - math.log(t(l2)))
    big = p.semi_major * m(l1) / (n * t(l1) ** n)
    rho0 = big * t(l0) ** n
    dx, dy = f"({x} - {p.false_east!r})", f"({rho0!r} - ({y} - {p.false_north!r}))"
    tt = f"pow(sqrt({dx} * {dx} + {dy} * {dy}) / {big!r}, {1 / n!r})"
    lon = f"degrees(atan2({dx}, {dy}) / {n!r} + {math.radians(p.lon0)!r})"
    return tt, lon


_TT, _LON = _inverse_sql("px", "py")
_ECC = math.sqrt(2 / geo.LAMBERT_93.flattening_inv - geo.LAMBERT_93.flattening_inv**-2)


def _iterate(rounds: int) -> str:
    sql = "SELECT *, pi() / 2 - 2 * atan(tt) AS phi FROM tt_rows"
    for i in range(rounds):
        sql = (
            f"SELECT * REPLACE (pi() / 2 - 2 * atan(tt * pow((1 - {_ECC!r} * sin(phi)) / (1 + {_ECC!r} * sin(phi)), "
            f"{_ECC / 2!r})) AS phi) FROM ({sql}) AS i{i}"
        )
    return sql


@query(
    "reproject_to_degrees",
    "event_id:i coord_class:s latitude_convert:d longitude_convert:d",
    f"""
    WITH b AS (SELECT e.*, t.kind, t.mx, t.my FROM ({PLACED_EVENTS}) e JOIN ({_METRES}) t USING (event_id)),
    raw AS (SELECT event_id,
        CASE kind WHEN 0 THEN lat WHEN 1 THEN lon WHEN 2 THEN my WHEN 3 THEN mx END AS la,
        CASE kind WHEN 0 THEN lon WHEN 1 THEN lat WHEN 2 THEN mx WHEN 3 THEN my END AS lo, kind, mx AS px, my AS py FROM b),
    c AS (SELECT *, CASE WHEN la IS NULL OR lo IS NULL THEN 'missing'
        WHEN {_holds(_D, 'la', 'lo')} THEN 'wgs84' WHEN {_holds(_METRE_BOX, 'la', 'lo')} THEN 'lambert93_like'
        WHEN {_holds(_D, 'lo', 'la')} THEN 'swapped_wgs84'
        WHEN {_holds(_METRE_BOX, 'lo', 'la')} THEN 'swapped_lambert93' ELSE 'invalid' END AS coord_class FROM raw),
    tt_rows AS (SELECT *, {_TT} AS tt, {_LON} AS lon_p FROM c),
    it AS ({_iterate(6)})
    SELECT event_id, coord_class,
      CASE coord_class WHEN 'wgs84' THEN la WHEN 'swapped_wgs84' THEN lo WHEN 'lambert93_like' THEN degrees(phi)
        WHEN 'swapped_lambert93' THEN degrees(phi) END AS latitude_convert,
      CASE coord_class WHEN 'wgs84' THEN lo WHEN 'swapped_wgs84' THEN la WHEN 'lambert93_like' THEN lon_p
        WHEN 'swapped_lambert93' THEN lon_p END AS longitude_convert
    FROM it
    """,
)
def reproject_to_degrees(spark, d):
    e, i = placed_events(spark, d), F.col("event_id")
    k = i % 5
    mx = F.lit(100000.0) + i * 7919 % 1100000
    my = F.lit(6050000.0) + i * 104729 % 1000000
    raw = e.select(
        "event_id",
        F.when(k == 0, F.col("lat")).when(k == 1, F.col("lon")).when(k == 2, my).when(k == 3, mx).alias("latitude"),
        F.when(k == 0, F.col("lon")).when(k == 1, F.col("lat")).when(k == 2, mx).when(k == 3, my).alias("longitude"),
    )
    cls = geo.classify_coordinates(raw, "latitude", "longitude", projected=_METRE_BOX)
    return geo.to_degrees(cls, "latitude", "longitude")


_R = geo.REPAIR_BOX


def _repair(c: str) -> str:
    branches = " ".join(
        f"WHEN {_holds(_R, f'latitude / {s!r}', f'longitude / {s!r}')} THEN {c} / {s!r}" for s in geo.REPAIR_SCALES
    )
    return f"CASE {branches} END"


@query(
    "coordinate_scale_repair",
    "event_id:i lat_norm:d lon_norm:d",
    f"SELECT event_id, {_repair('latitude')} AS lat_norm, {_repair('longitude')} AS lon_norm FROM ({BROKEN_EVENTS}) AS b",
)
def coordinate_scale_repair(spark, d):
    return geo.repair_scale(broken_events(spark, d), "latitude", "longitude")


@query(
    "geo_share",
    "geo_ratio:d",
    f"SELECT avg(CAST(latitude IS NOT NULL AND longitude IS NOT NULL AS INTEGER)) AS geo_ratio FROM ({BROKEN_EVENTS}) AS b",
)
def geo_share(spark, d):
    return geo.geo_share(broken_events(spark, d), "latitude", "longitude")


@query(
    "coordinate_range_check",
    "n_rows:i lat_out_of_range:i lon_out_of_range:i",
    f"""
    SELECT count(*) AS n_rows, count(*) FILTER (latitude NOT BETWEEN -90 AND 90) AS lat_out_of_range,
      count(*) FILTER (longitude NOT BETWEEN -180 AND 180) AS lon_out_of_range FROM ({BROKEN_EVENTS}) AS b
    """,
)
def coordinate_range_check(spark, d):
    return geo.range_check(broken_events(spark, d), "latitude", "longitude")


@query(
    "duplicate_coordinates",
    "n_rows:i n_duplicates:i duplicate_ratio:d",
    f"""
    SELECT count(*) AS n_rows, count(*) - count(DISTINCT row(latitude, longitude)) AS n_duplicates,
      (count(*) - count(DISTINCT row(latitude, longitude))) / CAST(count(*) AS DOUBLE) AS duplicate_ratio
    FROM ({BROKEN_EVENTS}) AS b
    """,
)
def duplicate_coordinates(spark, d):
    return geo.duplicate_coordinates(broken_events(spark, d), "latitude", "longitude")


_RES = [0, 1, 2, 3, 4, 5, 6]


@query(
    "hex_cells",
    "event_id:i " + " ".join(f"cell_res{r}:s" for r in _RES),
    cells_sql(_RES),
)
def hex_cells(spark, d):
    return geo.with_cells(placed_events(spark, d), "lat", "lon", _RES)


_CELL4 = f"SELECT DISTINCT q4, r4, cell_res4 FROM ({cells_sql([4])}) AS c"


def _cells4(spark, d):
    return geo.with_cells(placed_events(spark, d), "lat", "lon", [4]).select("cell_res4").distinct()


def _corner_sql(i: int) -> tuple[str, str]:
    e, a = C.edge_km(4), math.radians(60 * i - 30)
    x = f"({e * math.sqrt(3.0)!r} * (q4 + r4 / 2e0) + {e * math.cos(a)!r})"
    y = f"({e * 1.5!r} * r4 + {e * math.sin(a)!r})"
    return f"degrees({x} / {C.EARTH_RADIUS_KM * _SCALE!r})", f"degrees(asin({y} * {_SCALE / C.EARTH_RADIUS_KM!r}))"


@query(
    "hex_boundaries",
    "cell_res4:s " + " ".join(f"lon{i}:d lat{i}:d" for i in range(6)),
    "SELECT cell_res4, "
    + ", ".join(f"{_corner_sql(i)[0]} AS lon{i}, {_corner_sql(i)[1]} AS lat{i}" for i in range(6))
    + f" FROM ({_CELL4}) AS c",
)
def hex_boundaries(spark, d):
    b = geo.with_boundary(_cells4(spark, d), "cell_res4")
    corners = [F.col("boundary")[i][x].alias(f"{x}{i}") for i in range(6) for x in ("lon", "lat")]
    return b.select("cell_res4", *corners)


@query(
    "hex_neighbours",
    "cell_res4:s neighbour:s",
    f"""
    SELECT cell_res4, concat('4:', q4 + a, ':', r4 + b) AS neighbour FROM ({_CELL4}) AS c
    CROSS JOIN (SELECT unnest(range(-2, 3)) AS a) AS s1 CROSS JOIN (SELECT unnest(range(-2, 3)) AS b) AS s2
    WHERE abs(a + b) <= 2 AND NOT (a = 0 AND b = 0)
    """,
)
def hex_neighbours(spark, d):
    return geo.neighbours(_cells4(spark, d), "cell_res4", k=2)


_LAYER = " UNION ALL ".join(
    f"SELECT {r} AS resolution, cell_res{r} AS cell, count(*) AS n FROM p GROUP BY ALL" for r in (2, 3, 4)
)


def _long_cells(spark, d):
    p = geo.with_cells(placed_events(spark, d), "lat", "lon", [2, 3, 4])
    fine = p.groupBy("cell_res2", "cell_res3", "cell_res4").agg(F.count("*").alias("n"))
    items = F.array(
        *[F.struct(F.lit(r).alias("resolution"), F.col(f"cell_res{r}").alias("cell")) for r in (2, 3, 4)]
    )
    return fine.select(F.explode(items).alias("c"), "n").select("c.resolution", "c.cell", "n")


@query(
    "map_layer",
    "resolution:i cell:s total:i log_total:d max_in_resolution:i max_overall:i",
    f"""
    WITH p AS ({cells_sql([2, 3, 4])}), t AS ({_LAYER})
    SELECT resolution, cell, n AS total, ln(1 + n) AS log_total, max(n) OVER (PARTITION BY resolution) AS max_in_resolution,
      max(n) OVER () AS max_overall FROM t
    """,
)
def map_layer(spark, d):
    return geo.map_layer(_long_cells(spark, d), "resolution", "cell", "n")


@query(
    "cell_rollup_check",
    "cell_res2:s child_sum:i parent_value:i difference:i",
    f"""
    WITH p AS ({cells_sql([2, 3, 4])}),
    ch AS (SELECT cell_res2, sum(n) AS child_sum FROM (
             SELECT cell_res2, cell_res4, count(*) AS n FROM p GROUP BY ALL) AS x GROUP BY 1),
    pa AS (SELECT cell_res2, count(*) AS parent_value FROM p GROUP BY 1)
    SELECT cell_res2, child_sum, parent_value, child_sum - parent_value AS difference FROM ch JOIN pa USING (cell_res2)
    """,
)
def cell_rollup_check(spark, d):
    p = geo.with_cells(placed_events(spark, d), "lat", "lon", [2, 3, 4])
    fine = p.groupBy("cell_res4").agg(F.count("*").alias("n"))
    child = geo.parent_cell(geo.parent_cell(fine, "cell_res4", 4, 3, "cell_res3"), "cell_res3", 3, 2, "cell_res2")
    parent = p.groupBy("cell_res2").agg(F.count("*").alias("n"))
    return geo.rollup_check(child, parent, "cell_res2", "n")


@query(
    "geojson_features",
    "cell:s kind:s n_corners:i closed:b resolution:i value:i",
    f"""
    WITH p AS ({cells_sql([2, 3, 4])})
    SELECT cell_res3 AS cell, 'Polygon' AS kind, 7 AS n_corners, true AS closed, 3 AS resolution, count(*) AS value
    FROM p GROUP BY cell_res3
    """,
)
def geojson_features(spark, d):
    totals = _long_cells(spark, d).where(F.col("resolution") == 3).groupBy("resolution", "cell")
    feats = geo.geojson_features(totals.agg(F.sum("n").alias("n")), "resolution", "cell", "n")
    shape = (
        "struct<geometry: struct<type: string, coordinates: array<array<array<double>>>>, "
        "properties: struct<cell: string, value: bigint, resolution: int>>"
    )
    j = feats.select("cell", F.from_json("feature", shape).alias("j"))
    ring = F.col("j.geometry.coordinates")[0]
    return j.select(
        "cell",
        F.col("j.geometry.type").alias("kind"),
        F.size(ring).alias("n_corners"),
        (ring[0] == ring[6]).alias("closed"),
        "j.properties.resolution",
        "j.properties.value",
    )


# --- spatial clusters ---------------------------------------------------------------------------

# One street per user: places along a line, as far apart as the values of the user's events.
_STREETS = """
  SELECT event_id, 42e0 + user_id * 2e-2 + value * 1e-4 AS lat, 2e0 + (event_id % 3) * 1e-4 AS lon FROM events
"""


def street_events(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        (F.lit(42.0) + F.col("user_id") * F.lit(2e-2) + F.col("value") * F.lit(1e-4)).alias("lat"),
        (F.lit(2.0) + (F.col("event_id") % 3) * F.lit(1e-4)).alias("lon"),
    )


@query(
    "spatial_clusters",
    "n_members:i n_places:i min_lat:d max_lat:d min_lon:d max_lon:d",
    f"""
    WITH RECURSIVE p AS MATERIALIZED (SELECT lat, lon, count(*) AS n, row_number() OVER (ORDER BY lat, lon) AS id FROM ({_STREETS}) AS s GROUP BY lat, lon),
    c AS MATERIALIZED (SELECT *, CAST(floor(lat / 5e-4) AS BIGINT) AS k FROM p),
    e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM c a JOIN (SELECT *, unnest([k - 1, k, k + 1]) AS kk FROM c) b ON a.k = b.kk
          WHERE (a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon) <= 5e-4 * 5e-4),
    reach(id, root) AS (SELECT id, id FROM p UNION SELECT e.v, r.root FROM reach r JOIN e ON r.id = e.u AND e.v > r.root),
    m AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
    SELECT sum(n) AS n_members, count(*) AS n_places, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon
    FROM p JOIN m USING (id) GROUP BY root HAVING sum(n) >= 2
    """,
)
def spatial_clusters(spark, d):
    return clusters.spatial_clusters(street_events(spark, d), "lat", "lon")
