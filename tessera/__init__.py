"""Tessera: a PySpark-native analytics engine for LLM post-training data."""
