"""Tiling, detection merging and annotation analytics, declared on Spark DataFrames."""

__version__ = "0.1.0"
