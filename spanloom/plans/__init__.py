"""Named queries: Spark plans and, where SQL can say the same, their DuckDB text."""
