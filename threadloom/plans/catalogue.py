"""All queries of the library."""

from threadloom.plans import catalogue_eval, catalogue_json, catalogue_lookups, catalogue_passes, catalogue_search, catalogue_store, catalogue_text, catalogue_threads  # noqa: F401
from threadloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
