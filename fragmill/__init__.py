"""Relational analytics over content-addressed fragment collections, on PySpark."""

__version__ = "0.1.0"
