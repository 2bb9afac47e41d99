"""Relational operators as SQL plans that say the same in Spark and in DuckDB."""
