"""Operators of a large-scale training-data pipeline, each one DataFrame in, one
DataFrame out. Nothing else in the package imports this subpackage."""
