"""All registered queries."""

from tessera.queries import catalogs, changes, quality, series, server, streams, structures, views, windows  # noqa: F401
from tessera.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
