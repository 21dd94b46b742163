"""From findings to severity, points and an overall risk level."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points per severity, value weights, and risk levels.
SEVERITY_POINTS = {"low": 5, "medium": 15, "high": 35, "critical": 70}
VALUE_WEIGHTS = ((1, 1.0), (5, 1.2), (20, 1.5), (100, 2.0))
VALUE_WEIGHT_ABOVE = 2.5
RISK_LEVELS = {"ok": 0, "low": 20, "medium": 60, "high": 120, "critical": 200}


@dataclass(frozen=True)
class RiskRules:
    """Severity rules ``check -> (threshold or None, severity)``, multipliers and the cap per finding."""

    severity: dict[str, tuple[float | None, str]] = field(
        default_factory=lambda: {
            "time_gaps": (1, "high"),
            "cross_resolution": (0.02, "medium"),
            "z_score": (3.0, "high"),
        }
    )
    check_multiplier: dict[str, float] = field(
        default_factory=lambda: {"time_gaps": 1.0, "cross_resolution": 1.2, "z_score": 0.9}
    )
    issue_multiplier: dict[str, float] = field(
        default_factory=lambda: {
            "tool_failure": 1.5,
            "missing_time_periods": 1.2,
            "aggregation_mismatch": 1.3,
        }
    )
    cap: int = 120
    levels: dict[str, int] = field(default_factory=lambda: dict(RISK_LEVELS))


def _lookup(column: str, table: dict[str, float], default: float) -> Column:
    if not table:
        return F.lit(default)
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(column)], F.lit(default))


def with_severity(findings: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Configured severity when |value| reaches the rule's threshold, else low."""
    out = F
    for check, (threshold, severity) in rules.severity.items():
        hit = F.col("check") == check
        if threshold is not None:
            hit = hit & (F.col("value").isNull() | (F.abs("value") >= threshold))
        out = out.when(hit, severity)
    return findings.withColumn("severity", out.otherwise("low"))


def value_weight(value: Column) -> Column:
    out = F.when(value.isNull(), 1.0)
    for limit, weight in VALUE_WEIGHTS:
        out = out.when(value <= limit, weight)
    return out.otherwise(VALUE_WEIGHT_ABOVE)


def with_points(findings: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    base = _lookup("severity", {k: float(v) for k, v in SEVERITY_POINTS.items()}, 0.0)
    raw = (
        base
        * _lookup("check", rules.check_multiplier, 1.0)
        * _lookup("issue_type", rules.issue_multiplier, 1.0)
        * value_weight(F.col("value"))
    )
    return findings.withColumn("points", F.least(raw, F.lit(float(rules.cap))).cast("int"))


def risk_summary(scored: DataFrame, rules: RiskRules = RiskRules()) -> DataFrame:
    """Total points, risk level and number of findings."""
    total = scored.agg(
        F.coalesce(F.sum("points"), F.lit(0)).alias("total_score"), F.count(F.lit(1)).alias("finding_count")
    )
    level = F
    for name, limit in sorted(rules.levels.items(), key=lambda kv: -kv[1]):
        level = level.when(F.col("total_score") >= limit, name)
    return total.withColumn("risk_level", level.otherwise("ok"))


def top_findings(scored: DataFrame, n: int = 5) -> DataFrame:
    return scored.orderBy(F.desc("points"), "check", "column").limit(n)
