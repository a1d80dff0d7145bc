"""The checked queries: every operator on the given tables, with its SQL."""

from importlib import import_module

MODULES = ("observations", "requests", "registry", "rates")


def load() -> None:
    """Register all queries."""
    for name in MODULES:
        import_module(f"tidegauge.catalog.{name}")
