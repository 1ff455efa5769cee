"""Tamarack: a PySpark-native engine for document indexing, retrieval and analytics."""

__version__ = "0.1.0"
