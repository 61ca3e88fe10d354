"""Declarative quality gate for tabular text, run as Spark jobs."""
