"""Registered queries by theme: each module has QUERIES (spark, folder -> DataFrame) and ORACLE_SQL, their DuckDB text."""
