"""Discrete global grid analytics expressed as Spark DataFrame operations."""
