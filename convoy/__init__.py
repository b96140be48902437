"""Spark jobs over a fleet of source repositories."""
