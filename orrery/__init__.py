"""Spark-native analytics over hierarchical grids and content-addressed tiles."""
