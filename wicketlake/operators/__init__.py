"""Joins, aggregations, windows and search over the delivery and document tables."""
