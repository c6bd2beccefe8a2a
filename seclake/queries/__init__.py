"""Queries on the supplied tables; importing the modules registers them."""

from importlib import import_module

MODULES = ["text", "search", "evidence", "traffic", "posture"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"seclake.queries.{name}")
