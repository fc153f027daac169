"""Retail star-schema analytics as PySpark DataFrame jobs."""
