"""Spark-native raster, graph and corpus analytics."""
