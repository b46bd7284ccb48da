"""Operators of a training-data pipeline: search, filtering, near-duplicate
removal, packing and token files. Nothing else in the library imports this
subpackage."""
