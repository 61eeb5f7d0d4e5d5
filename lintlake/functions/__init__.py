"""Spark jobs of the findings library."""
