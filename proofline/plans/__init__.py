"""Bundled model pipelines and the registry of checked queries."""

from importlib import import_module

from .base import ORACLES, QUERIES

MODULES = ("q_shop", "q_care", "q_keys", "q_diff", "q_tests", "q_audits", "q_catalog", "q_graph", "q_changes", "q_streams")


def load() -> None:
    for name in MODULES:
        import_module(f".{name}", __name__)


__all__ = ["ORACLES", "QUERIES", "load"]
