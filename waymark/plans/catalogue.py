"""Registered queries of the track operators and the SQL they are compared with."""

from . import audit_queries, correction_queries

QUERIES: dict = audit_queries.QUERIES | correction_queries.QUERIES
ORACLE: dict[str, str] = audit_queries.ORACLE | correction_queries.ORACLE
