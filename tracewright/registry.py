"""Name -> query callable, and name -> DuckDB SQL."""

from tracewright.plans import nested, rules  # noqa: F401  (registers its queries)
from tracewright.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
