"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "time_cube",
    "sparse_series",
    "geo_cells",
    "resolution_metrics",
    "quality_checks",
    "cleaning",
    "flags_graph",
    "model_evaluation",
    "models",
    "boosted",
    "end_to_end",
)


def load_all():
    from hexcadence.workload import base

    for m in MODULES:
        import_module(f"hexcadence.workload.{m}")
    return base.QUERIES, base.ORACLES
