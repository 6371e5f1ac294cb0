"""Every registered query of the analytics operators, with its SQL equivalent."""

from . import analysis, further, relational  # noqa: F401  the modules register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
