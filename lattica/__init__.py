"""Spark-native analytics over sets of overlapping images."""
