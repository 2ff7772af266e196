"""Every registered query with, where SQL can state it, its expected result."""

from __future__ import annotations

from veilspark.plans.catalog import (  # noqa: F401
    audit, crypto, detection, dumps, lifecycle, masking, positions, risk, routing, rules, sources, tables, views)
from veilspark.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
