"""Spark-native analytics over version-pinned package documentation."""
