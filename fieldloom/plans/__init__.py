"""Registered queries, grouped as the operators are."""

from importlib import import_module

MODULES = (
    "filters", "quality", "sources", "joins", "aggregates", "timeseries", "windows", "sets", "scalars",
    "texts", "streams", "graphs", "causal", "evaluation", "robust", "rasters", "callables", "scores",
)


def load_all() -> None:
    """Import every module of registered queries."""
    for name in MODULES:
        import_module(f"fieldloom.plans.{name}")
