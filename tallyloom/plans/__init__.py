"""Named queries over the test tables and the SQL that gives the same rows."""

from . import imports, listing, rules, search, summaries, text, timelines, tracking, upkeep  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
