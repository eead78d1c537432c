"""Named queries over the bound tables."""

from importlib import import_module

MODULES = ["timetable_queries", "demand_queries", "network_queries", "route_queries", "resample_queries", "telemetry_queries"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"transitloom.plans.{name}")
