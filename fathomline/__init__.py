"""Retrieval and financial-text analytics as PySpark DataFrame operators."""
