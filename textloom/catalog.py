"""Every registered query by name, and the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from textloom.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "quality_report"
for _topic in ("listening", "measures", "ordering", "sampling", "joining", "trees", "vectors", "quality", "textual", "sequences", "streams", "repairs", "grouping", "wording", "marking", "pages", "glyphs", "fits", "flowing", "drifting"):
    import_module(f"textloom.plans.{_topic}")

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
