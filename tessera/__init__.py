"""Annotation reliability analytics on PySpark."""
