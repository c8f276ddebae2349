"""Catalogue matching, ranking and evaluation as Spark jobs."""
