"""Spark-native analytics over hostname-like artifacts, their embeddings and de-identified releases."""
