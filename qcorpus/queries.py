"""All registered queries of the engine."""

from .plans import browse, corpus, documents, imports, parsing, records, usage  # noqa: F401  (they register themselves)
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
