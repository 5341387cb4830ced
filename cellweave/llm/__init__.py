"""Operators of a training-data pipeline: one module each, every one a Spark job over whole tables.

``QUERIES`` and ``SQL`` hold what ``__spark_entry__.py`` registers.
"""
