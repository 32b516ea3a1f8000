"""Registered queries, a module for each family; each has ``QUERIES``:
name -> (callable, DuckDB statement or None)."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("execution", "text", "runs", "lookups", "ordered", "rules", "graphs", "documents", "writes", "streams", "nested", "scope", "coverage", "records", "summaries", "workflow", "docgraph", "printimage", "sections", "structure", "views")


def all_queries() -> dict:
    found: dict = {}
    for family in FAMILIES:
        found |= import_module(f"rulespan.queries.{family}").QUERIES
    return found
