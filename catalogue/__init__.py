"""Queries of the library over the given tables, and the same questions in SQL."""
