"""Retrieval, span and corpus analytics as PySpark DataFrame operators."""
