"""Queries over the provided tables, and whole-run drivers."""

from __future__ import annotations

import importlib

MODULES = ("matrix_queries", "merge_queries", "trace_queries", "report_queries", "chem_queries", "pass_queries", "reread_queries", "batch_queries")


def load_catalog():
    """Import every query module and return (queries, SQL twins)."""
    for name in MODULES:
        importlib.import_module(f"ionloom.plans.{name}")
    registry = importlib.import_module("ionloom.plans.registry")
    return registry.QUERIES, registry.ORACLES
