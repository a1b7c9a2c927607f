"""Named queries over the standard tables, and the SQL that each is held against."""

from lodestone.plans.oracle import ORACLE_SQL
from lodestone.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
