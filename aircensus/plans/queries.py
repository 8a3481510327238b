"""All queries of the library proper."""

from __future__ import annotations

from . import catalog, catalog_io, catalog_packets

QUERIES, ORACLE_SQL = catalog.QUERIES, catalog.ORACLE_SQL
__all__ = ["QUERIES", "ORACLE_SQL", "catalog_io", "catalog_packets"]
