"""Stratalith: layered retrieval and state analytics expressed with PySpark."""

__version__ = "0.1.0"
