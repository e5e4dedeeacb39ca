"""Independent SQL for checking the Spark queries on the same tables (DuckDB dialect)."""
