"""Named queries and the SQL that they must agree with."""
from millrace.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
