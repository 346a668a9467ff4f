"""Named queries over the shared tables and their SQL counterparts."""

from tidyloom.catalog import cleaning, models, policy, profiling, scoring, storage  # noqa: F401
from tidyloom.catalog.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
