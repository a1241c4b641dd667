"""All registered queries of the engine and their oracle SQL."""

from .oracle import ORACLE_SQL
from .queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
