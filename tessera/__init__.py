"""Spark-first retrieval analytics."""
