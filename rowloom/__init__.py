"""Pair-dataset analytics on Spark: operators, sources, functions, plans and streaming wrappers."""

__version__ = "0.1.0"
