"""Orthostat: a Spark-first analytics engine for site catalogues and their knowledge graph."""

__version__ = "0.1.0"
