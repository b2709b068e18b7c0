"""Annotated-text and network analytics as Spark DataFrame operators."""
