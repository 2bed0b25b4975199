"""Syntax-aware analytics on Spark: text and tables in one set of DataFrame operators."""
