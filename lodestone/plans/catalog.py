"""All registered queries of the engine's own operators."""

from . import ingest, located, relational, textual  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
