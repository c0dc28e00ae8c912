"""The query catalogue: each operator on the given tables, and the same in DuckDB's SQL."""
