"""Registered queries with their DuckDB counterparts."""

from tidemark.queries import blends, encoders, histories, models, rankings, scans, training
from tidemark.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "blends", "encoders", "histories", "models", "rankings", "scans", "training"]
