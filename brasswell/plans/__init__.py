"""Queries, each with the SQL it is held against."""
