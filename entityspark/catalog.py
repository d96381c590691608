"""All registered queries of the engine."""

from __future__ import annotations

from .queries import entities, live, measures, space, versions  # noqa: F401
from .queries.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
