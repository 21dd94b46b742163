"""Flags from coded columns: one rule table, one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexcadence.operators.relational import map_values

# Flag -> (column, codes).
MANEUVER_FLAGS = {
    "is_turning": ("maneuver", (10, 15, 16)),
    "is_lane_change": ("maneuver", (11, 12)),
    "is_overtaking": ("maneuver", (17, 18)),
}
VEHICLE_TYPE_FLAGS = {
    "is_vulnerable_vehicle": ("vehicle_type", (1, 2, 30, 31, 32, 33, 34, 80)),
    "is_heavy_vehicle": ("vehicle_type", (13, 14, 15, 16, 17, 21)),
}
IMPACT_FLAGS = {
    "is_frontal_impact": ("impact_point", (1, 2, 3)),
    "is_rear_impact": ("impact_point", (4, 5, 6)),
    "is_side_impact": ("impact_point", (7, 8)),
    "is_rollover": ("impact_point", (9,)),
}
URBAN_FLAGS = {"is_urban": ("road_type", (4, 7))}
SURFACE_FLAGS = {
    "is_slippery": ("surface_condition", (2, 3, 4, 5, 6, 7, 8)),
    "is_curve": ("road_geometry", (2, 3, 4)),
    "is_complex_infra": ("infrastructure", (3, 5)),
}
EQUIPMENT_CODES = {"has_seatbelt": 1, "has_helmet": 2, "has_child_seat": 3}
INJURY_ORDER = {"1": 1, "2": 4, "3": 3, "4": 2}
HIGH_SPEED, CURVE_SPEED, URBAN_SPEED = 90, 80, 50
YOUNG_BELOW, ELDERLY_ABOVE = 25, 65


def code_flag(column: str, codes: Sequence[int]) -> Column:
    """True when the code is listed; unknown codes are False."""
    return F.coalesce(F.col(column).isin(list(codes)), F.lit(False))


def _true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def add_code_flags(df: DataFrame, rules: dict[str, tuple[str, Sequence[int]]]) -> DataFrame:
    return df.withColumns({flag: code_flag(c, codes) for flag, (c, codes) in rules.items()})


def add_vehicle_flags(df: DataFrame) -> DataFrame:
    """Maneuver, vehicle type and impact flags."""
    return add_code_flags(df, {**MANEUVER_FLAGS, **VEHICLE_TYPE_FLAGS, **IMPACT_FLAGS})


def add_obstacle_flags(df: DataFrame, fixed: str = "fixed_obstacle", mobile: str = "mobile_obstacle") -> DataFrame:
    return df.withColumns(
        {
            "collision_object": F.concat_ws("_", F.col(fixed).cast("string"), F.col(mobile).cast("string")),
            "hit_another_vehicle": _true((F.col(mobile) == 2) | (F.col(fixed) == 1)),
            "hit_a_pedestrian": code_flag(mobile, (1,)),
        }
    )


def add_vehicle_counts(df: DataFrame, accident: str, vehicle: str) -> DataFrame:
    """First-vehicle flag and distinct vehicles per accident, repeated on each of its rows.

    Distinct counts are aggregated and joined back: no window over a possibly large accident.
    """
    counts = df.groupBy(accident).agg(F.countDistinct(vehicle).alias("n_vehicles"))
    return df.join(counts, accident, "left").withColumn("is_first_vehicle", _true(F.col(vehicle) == 1))


def add_risk_pattern(df: DataFrame, maneuver: str = "maneuver", impact: str = "impact_point") -> DataFrame:
    pattern = F.concat_ws("_", F.col(maneuver).cast("string"), F.col(impact).cast("string"))
    return df.withColumn("risk_pattern", pattern)


def add_road_flags(
    df: DataFrame,
    speed: str = "speed_limit",
    lanes: str = "n_lanes",
    road_type: str = "road_type",
    road_number: str = "road_number",
) -> DataFrame:
    """Highway, speed, surface, geometry and lane flags; ``is_risky_road`` combines four of them."""
    out = add_code_flags(df, {**SURFACE_FLAGS, **URBAN_FLAGS})
    v, n = F.col(speed), F.col(lanes)
    out = out.withColumns(
        {
            "is_highway": _true((F.col(road_type) == 1) & F.col(road_number).startswith("A")),
            "is_high_speed": _true(v >= HIGH_SPEED),
            "is_urban_speed": _true(v <= URBAN_SPEED),
            "is_multilane": _true(n > 2),
            "risk_speed_curve": _true(v >= CURVE_SPEED) & F.col("is_curve"),
        }
    )
    risky = F.col("is_curve") & F.col("is_slippery") & _true(n <= 2) & _true(v >= CURVE_SPEED)
    return out.withColumn("is_risky_road", risky)


def ordinal_injury(df: DataFrame, column: str = "injury_severity", out: str = "injury_sev_corr") -> DataFrame:
    """Severity codes in ascending order of harm; the input column is dropped."""
    text = df.withColumn("_code", F.col(column).cast("string"))
    return map_values(text, "_code", INJURY_ORDER, out).drop("_code", column)


def add_pedestrian_risk(
    df: DataFrame, person: str = "person_type", location: str = "pedest_location", action: str = "pedest_action"
) -> DataFrame:
    risk = (F.col(person) == 3) & F.col(location).isin(3, 4, 5) & (F.col(action) == 3)
    return df.withColumn("risk_profile", _true(risk))


def add_age_flags(df: DataFrame, year: str = "year", birth_year: str = "birth_year") -> DataFrame:
    age = F.col(year) - F.col(birth_year)
    return df.withColumns(
        {"is_young": _true(age < YOUNG_BELOW), "is_elderly": _true(age > ELDERLY_ABOVE)}
    ).drop(birth_year)


def add_equipment_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which equipment occurs in any of the code columns, protection, and how many codes are positive."""
    codes = F.array(*[F.col(c).cast("int") for c in columns])
    out = df.withColumns(
        {
            flag: _true(F.array_contains(F.array_compact(codes), code)).cast("int")
            for flag, code in EQUIPMENT_CODES.items()
        }
    )
    positive = [_true(F.col(c) > 0).cast("int") for c in columns]
    total = positive[0]
    for p in positive[1:]:
        total = total + p
    protected = (F.col("has_seatbelt") == 1) | (F.col("has_helmet") == 1)
    return out.withColumns({"is_protected": protected, "n_safety_measures": total})


def split_old_equipment(df: DataFrame, column: str) -> DataFrame:
    """Two-digit code to (has, used) digits; -1 and 0 mean neither."""
    c = F.col(column).cast("int")
    digits = F.lpad(c.cast("string"), 2, "0")
    none = c.isin(-1, 0)
    return df.withColumns(
        {
            "has_equipment": F.when(none, 0).otherwise(F.substring(digits, 1, 1).try_cast("int")),
            "used_equipment": F.when(none, 0).otherwise(F.substring(digits, 2, 1).try_cast("int")),
        }
    )
