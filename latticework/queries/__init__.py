"""The library's operators bound to whole tables, with SQL for the same rows."""

from __future__ import annotations

from . import grids, measured, numbers, vectors

_PARTS = (grids, vectors, numbers, measured)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
