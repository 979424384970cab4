"""The library's queries over the driver's tables and their SQL twins."""

from auditlake.queries import confirmation, curves, documents, journal, market  # noqa: F401
from auditlake.queries.common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
