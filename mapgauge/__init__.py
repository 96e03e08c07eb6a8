"""Geospatial language-model evaluation on Spark."""
