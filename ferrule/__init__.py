"""Spark-native analytics over semi-structured engineering artefacts."""
