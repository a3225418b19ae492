"""Spark-first analytics for document, dictionary and operations data."""
