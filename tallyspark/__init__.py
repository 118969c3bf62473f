"""Spark-native analytics over captured LLM API traffic."""
