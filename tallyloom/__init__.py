"""Spark-native analytics over semi-structured receipt text."""
