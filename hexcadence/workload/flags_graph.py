"""Queries on coded-column flags and on the neighbourhood graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexcadence.functions import timefn as T
from hexcadence.operators import cube, flags, geo, graph
from hexcadence.workload.base import placed_events, query, sql_bin, table
from hexcadence.workload.geo_cells import cells_sql

# --- flags --------------------------------------------------------------------------------------

_CODES = """
  SELECT l_orderkey, l_linenumber, l_partkey % 27 AS maneuver, l_suppkey % 100 AS vehicle_type,
    l_partkey % 10 AS impact_point, l_suppkey % 18 AS fixed_obstacle, l_partkey % 3 AS mobile_obstacle,
    1 + l_suppkey % 7 AS road_type, CASE WHEN l_partkey % 2 = 0 THEN 'A' || l_suppkey ELSE 'D' || l_suppkey END AS road_number,
    30 + 10 * (l_partkey % 11) AS speed_limit, 1 + l_suppkey % 5 AS n_lanes, l_partkey % 10 AS surface_condition,
    l_suppkey % 5 AS road_geometry, l_partkey % 7 AS infrastructure, 1 + l_partkey % 4 AS injury_severity,
    1 + l_suppkey % 3 AS person_type, l_partkey % 7 AS pedest_location, l_suppkey % 7 AS pedest_action,
    year(l_shipdate) AS year, year(l_shipdate) - l_partkey % 95 AS birth_year,
    l_partkey % 6 - 1 AS secu1, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 6 - 1 END AS secu2, l_linenumber % 4 AS secu3,
    l_partkey % 35 - 1 AS old_secu
  FROM lineitem
"""


def coded(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    y = F.year("l_shipdate")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (p % 27).alias("maneuver"),
        (s % 100).alias("vehicle_type"),
        (p % 10).alias("impact_point"),
        (s % 18).alias("fixed_obstacle"),
        (p % 3).alias("mobile_obstacle"),
        (1 + s % 7).alias("road_type"),
        F.concat(F.when(p % 2 == 0, "A").otherwise("D"), s.cast("string")).alias("road_number"),
        (30 + 10 * (p % 11)).alias("speed_limit"),
        (1 + s % 5).alias("n_lanes"),
        (p % 10).alias("surface_condition"),
        (s % 5).alias("road_geometry"),
        (p % 7).alias("infrastructure"),
        (1 + p % 4).alias("injury_severity"),
        (1 + s % 3).alias("person_type"),
        (p % 7).alias("pedest_location"),
        (s % 7).alias("pedest_action"),
        y.alias("year"),
        (y - p % 95).alias("birth_year"),
        (p % 6 - 1).alias("secu1"),
        F.when(s % 4 > 0, s % 6 - 1).alias("secu2"),
        (F.col("l_linenumber") % 4).alias("secu3"),
        (p % 35 - 1).alias("old_secu"),
    )


def _in(c, codes):
    return f"coalesce({c} IN ({', '.join(map(str, codes))}), false)"


_VEHICLE_RULES = {**flags.MANEUVER_FLAGS, **flags.VEHICLE_TYPE_FLAGS, **flags.IMPACT_FLAGS}


@query(
    "vehicle_flags",
    "l_orderkey:i l_linenumber:i collision_object:s hit_another_vehicle:b hit_a_pedestrian:b risk_pattern:s "
    + " ".join(f"{f}:b" for f in _VEHICLE_RULES),
    f"""
    SELECT l_orderkey, l_linenumber, concat(fixed_obstacle, '_', mobile_obstacle) AS collision_object,
      mobile_obstacle = 2 OR fixed_obstacle = 1 AS hit_another_vehicle, mobile_obstacle = 1 AS hit_a_pedestrian,
      concat(maneuver, '_', impact_point) AS risk_pattern,
      {', '.join(f'{_in(c, codes)} AS {f}' for f, (c, codes) in _VEHICLE_RULES.items())} FROM ({_CODES}) AS c
    """,
)
def vehicle_flags(spark, d):
    return flags.add_risk_pattern(flags.add_obstacle_flags(flags.add_vehicle_flags(coded(spark, d))))


@query(
    "vehicle_counts",
    "l_orderkey:i l_linenumber:i n_vehicles:i is_first_vehicle:b",
    """
    SELECT l.l_orderkey, l_linenumber, n_vehicles, l_linenumber = 1 AS is_first_vehicle FROM lineitem l
    JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_vehicles FROM lineitem GROUP BY 1) c ON l.l_orderkey = c.l_orderkey
    """,
)
def vehicle_counts(spark, d):
    return flags.add_vehicle_counts(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


_ROAD = {**flags.SURFACE_FLAGS, **flags.URBAN_FLAGS}


@query(
    "road_flags",
    "l_orderkey:i l_linenumber:i is_highway:b is_high_speed:b is_urban_speed:b is_multilane:b risk_speed_curve:b "
    "is_risky_road:b " + " ".join(f"{f}:b" for f in _ROAD),
    f"""
    SELECT *, road_type = 1 AND starts_with(road_number, 'A') AS is_highway, speed_limit >= 90 AS is_high_speed,
      speed_limit <= 50 AS is_urban_speed, n_lanes > 2 AS is_multilane, speed_limit >= 80 AND is_curve AS risk_speed_curve,
      is_curve AND is_slippery AND n_lanes <= 2 AND speed_limit >= 80 AS is_risky_road
    FROM (SELECT *, {', '.join(f'{_in(c, codes)} AS {f}' for f, (c, codes) in _ROAD.items())} FROM ({_CODES}) AS c) AS r
    """,
)
def road_flags(spark, d):
    return flags.add_road_flags(coded(spark, d))


@query(
    "person_flags",
    "l_orderkey:i l_linenumber:i injury_sev_corr:i risk_profile:b is_young:b is_elderly:b has_seatbelt:i has_helmet:i "
    "has_child_seat:i is_protected:b n_safety_measures:i has_equipment:i used_equipment:i",
    f"""
    SELECT *, has_seatbelt = 1 OR has_helmet = 1 AS is_protected FROM (
      SELECT l_orderkey, l_linenumber, CASE injury_severity WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 END AS injury_sev_corr,
        person_type = 3 AND pedest_location IN (3, 4, 5) AND pedest_action = 3 AS risk_profile,
        year - birth_year < 25 AS is_young, year - birth_year > 65 AS is_elderly,
        CAST(secu1 = 1 OR coalesce(secu2 = 1, false) OR secu3 = 1 AS INTEGER) AS has_seatbelt,
        CAST(secu1 = 2 OR coalesce(secu2 = 2, false) OR secu3 = 2 AS INTEGER) AS has_helmet,
        CAST(secu1 = 3 OR coalesce(secu2 = 3, false) OR secu3 = 3 AS INTEGER) AS has_child_seat,
        CAST(secu1 > 0 AS INTEGER) + CAST(coalesce(secu2 > 0, false) AS INTEGER) + CAST(secu3 > 0 AS INTEGER) AS n_safety_measures,
        CASE WHEN old_secu IN (-1, 0) THEN 0 ELSE old_secu // 10 END AS has_equipment,
        CASE WHEN old_secu IN (-1, 0) THEN 0 ELSE old_secu % 10 END AS used_equipment
      FROM ({_CODES}) AS c) AS p
    """,
)
def person_flags(spark, d):
    out = flags.add_age_flags(flags.add_pedestrian_risk(flags.ordinal_injury(coded(spark, d))))
    return flags.split_old_equipment(flags.add_equipment_flags(out, ["secu1", "secu2", "secu3"]), "old_secu")


# --- graph --------------------------------------------------------------------------------------

_CELL_COUNTS = f"SELECT cell_res2, q2, r2, count(*) AS n FROM ({cells_sql([2])}) AS c GROUP BY ALL"
_NODES = f"""
  SELECT cell_res2, q2, r2, row_number() OVER (ORDER BY cell_res2) - 1 AS node_id FROM ({_CELL_COUNTS}) AS k WHERE n >= 2
"""
_PAIRS = """
  SELECT a.node_id AS src, b.node_id AS dst FROM nodes a JOIN nodes b
  ON abs(a.q2 - b.q2) <= 1 AND abs(a.r2 - b.r2) <= 1 AND abs(a.q2 - b.q2 + a.r2 - b.r2) <= 1 AND a.node_id <> b.node_id
"""
_GRAPH = f"""
  nodes AS ({_NODES}), pairs AS ({_PAIRS}),
  edges AS (SELECT * FROM pairs UNION ALL SELECT DISTINCT src, src FROM pairs)
"""


def _placed2(spark, d):
    return geo.with_cells(placed_events(spark, d), "lat", "lon", [2])


def _nodes(spark, d):
    counts = _placed2(spark, d).groupBy("cell_res2").agg(F.count("*").alias("n"))
    return graph.node_index(counts, "cell_res2", "n", 2)


@query("graph_nodes", "cell_res2:s node_id:i", _NODES)
def graph_nodes(spark, d):
    return _nodes(spark, d)


@query("graph_edges", "src:i dst:i", f"WITH {_GRAPH} SELECT * FROM edges")
def graph_edges(spark, d):
    return graph.edges(_nodes(spark, d), "cell_res2", 1, True)


@query(
    "graph_info",
    "total_nodes:i connected_nodes:i isolated_nodes:i isolated_percent:d n_edges:i edges_per_node:d",
    f"""
    WITH {_GRAPH}, s AS (SELECT (SELECT count(*) FROM nodes) AS t, (SELECT count(DISTINCT src) FROM edges) AS c,
      (SELECT count(*) FROM edges) AS e)
    SELECT t AS total_nodes, c AS connected_nodes, t - c AS isolated_nodes, 100e0 * (t - c) / t AS isolated_percent,
      e AS n_edges, CAST(e AS DOUBLE) / t AS edges_per_node FROM s
    """,
)
def graph_info(spark, d):
    nodes = _nodes(spark, d)
    return graph.graph_info(nodes, graph.edges(nodes, "cell_res2"))


_NODE_FEATURES = f"""
  counts AS (SELECT cell_res2, {sql_bin('ts', 'weekly')} AS time_bin, count(*) AS n FROM ({cells_sql([2])}) AS c GROUP BY ALL),
  feat AS (SELECT nodes.node_id, b.time_bin, coalesce(counts.n, 0) AS n FROM nodes CROSS JOIN (SELECT DISTINCT time_bin FROM counts) b
    LEFT JOIN counts ON counts.cell_res2 = nodes.cell_res2 AND counts.time_bin = b.time_bin)
"""


def _node_features(spark, d, nodes):
    binned = _placed2(spark, d).withColumn("time_bin", T.bin_start("ts", "weekly"))
    counts = cube.count_cube(binned, "cell_res2", "time_bin")
    grid = cube.densify(counts, "cell_res2", "time_bin", "n", "weekly", min_events=2)
    return grid.join(nodes, "cell_res2").select("node_id", "time_bin", "n")


@query(
    "neighbour_mean",
    "node_id:i time_bin:t nb_n:d",
    f"""
    WITH {_GRAPH}, {_NODE_FEATURES}
    SELECT dst AS node_id, time_bin, avg(n) AS nb_n FROM edges JOIN feat ON edges.src = feat.node_id GROUP BY 1, 2
    """,
)
def neighbour_mean(spark, d):
    nodes = _nodes(spark, d)
    return graph.propagate(graph.edges(nodes, "cell_res2"), _node_features(spark, d, nodes), "time_bin", ["n"])


_DEG = "deg AS (SELECT dst AS id, CAST(count(*) AS DOUBLE) AS k FROM edges GROUP BY 1)"
_W = "1e0 / sqrt(ds.k * dd.k)"


@query(
    "neighbour_two_hops",
    "node_id:i time_bin:t nb_n:d",
    f"""
    WITH {_GRAPH}, {_NODE_FEATURES}, {_DEG},
    w AS (SELECT src, dst, {_W} AS w FROM edges JOIN deg ds ON ds.id = src JOIN deg dd ON dd.id = dst),
    h1 AS (SELECT dst AS node_id, time_bin, sum(n * w) AS n FROM w JOIN feat ON w.src = feat.node_id GROUP BY 1, 2)
    SELECT dst AS node_id, time_bin, sum(n * w) AS nb_n FROM w JOIN h1 ON w.src = h1.node_id GROUP BY 1, 2
    """,
)
def neighbour_two_hops(spark, d):
    nodes = _nodes(spark, d)
    return graph.propagate(
        graph.edges(nodes, "cell_res2"), _node_features(spark, d, nodes), "time_bin", ["n"], hops=2, how="sym"
    )


_DAILY_GRID = f"""
  c AS (SELECT user_id, {sql_bin('ts', 'daily')} AS time_bin, count(*) AS n FROM events GROUP BY 1, 2),
  g AS (SELECT a.user_id, b.time_bin, coalesce(c.n, 0) AS n FROM (SELECT user_id FROM c GROUP BY 1 HAVING sum(n) >= 2) a
    CROSS JOIN (SELECT DISTINCT time_bin FROM c) b LEFT JOIN c ON c.user_id = a.user_id AND c.time_bin = b.time_bin)
"""


@query(
    "forecast_baselines",
    "user_id:i time_bin:t persistence:i always_zero:i always_one:i scaled_persistence:d",
    f"""
    WITH {_DAILY_GRID}
    SELECT user_id, time_bin, CAST(n > 0 AS INTEGER) AS persistence, 0 AS always_zero, 1 AS always_one,
      least(greatest(n / (max(n) OVER (PARTITION BY time_bin) + 1e-6), 0), 1) AS scaled_persistence FROM g
    """,
)
def forecast_baselines(spark, d):
    counts = cube.count_cube(
        table(spark, d, "events").withColumn("time_bin", T.bin_start("ts", "daily")), "user_id", "time_bin"
    )
    grid = cube.densify(counts, "user_id", "time_bin", "n", "daily", min_events=2)
    return graph.baselines(grid, "n", "time_bin")


@query(
    "baselines_null_bins",
    "event_id:i persistence:i scaled_persistence:d",
    f"""
    WITH e AS (SELECT event_id, value, CASE WHEN event_id % 4 != 0 THEN {sql_bin('ts', 'daily')} END AS time_bin FROM events)
    SELECT event_id, CAST(value > 0 AS INTEGER) AS persistence,
      least(greatest(value / (max(value) OVER (PARTITION BY time_bin) + 1e-6), 0), 1) AS scaled_persistence FROM e
    """,
)
def baselines_null_bins(spark, d):
    day = F.when(F.col("event_id") % 4 != 0, T.bin_start("ts", "daily"))
    return graph.baselines(table(spark, d, "events").withColumn("time_bin", day), "value", "time_bin")
