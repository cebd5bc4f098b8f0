"""Registered queries of the container operators: QUERIES, and the same results in DuckDB's SQL in ORACLES."""

from pixelloom.queries import color, containers, derived, geometry, metadata, pipelines, planes, sequence  # noqa: F401
from pixelloom.queries.registry import ORACLES, QUERIES  # noqa: F401
