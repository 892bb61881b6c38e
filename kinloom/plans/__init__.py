"""Queries on the driver's tables."""

from importlib import import_module

MODULES = ("registers", "names", "linkage", "parish", "stock", "changes", "files")


def load() -> None:
    """Import all query modules, which registers their queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
