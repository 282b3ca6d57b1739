"""Registered queries over the benchmark tables, with a DuckDB twin where SQL can say it."""
