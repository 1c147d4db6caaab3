"""Spark-native graph, retrieval and provenance analytics over plain DataFrames."""
