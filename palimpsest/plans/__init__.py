"""Logical side: filter trees, queries and the query language."""
