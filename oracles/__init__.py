"""DuckDB statements that compute the expected result of each query from the raw tables."""
