"""What the entry point registers of this subpackage."""

from sondera.llm.oracle import oracle_sql
from sondera.llm.queries import queries

__all__ = ["oracle_sql", "queries"]
