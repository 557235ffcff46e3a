"""Tessera: chunked n-dimensional arrays and their catalogues as Spark DataFrames."""

__version__ = "0.1.0"
