"""Hybrid retrieval and training-data preparation as Spark DataFrame programs."""
