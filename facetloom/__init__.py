"""Faceted product search, ranking and ranking-data preparation as Spark jobs."""
