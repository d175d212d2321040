"""Operators of a training-data pipeline: text filters, joins, packing and search."""
