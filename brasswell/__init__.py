"""Catalogue and similarity analytics on Spark."""
