"""The registered queries, by subject. Each module has QUERIES (name to function of session and folder) and SQL (the same in DuckDB)."""
