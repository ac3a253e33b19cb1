"""Registry of the engine's queries and of the SQL that states their results."""

from __future__ import annotations

from caselens.queries import audits, profiling, retrieval, workflow

QUERIES = retrieval.QUERIES | profiling.QUERIES | workflow.QUERIES | audits.QUERIES
SQL = retrieval.SQL | profiling.SQL | workflow.SQL | audits.SQL
