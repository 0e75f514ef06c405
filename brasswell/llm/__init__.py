"""Operators of a large-scale training-data pipeline, each built by one named method."""
