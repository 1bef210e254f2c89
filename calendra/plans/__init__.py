"""Importing this package registers every query."""

from importlib import import_module

from calendra.plans.registry import ORACLES, QUERIES

for _module in ("distribution_queries", "recurrence_queries", "calendar_queries", "kpi_queries", "geo_queries", "matching_queries", "source_queries", "overlay_queries", "catalog_queries", "layout_queries", "stream_queries"):
    import_module(f"calendra.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
