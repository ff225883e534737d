"""Lamella: Spark-native analytics for large scientific image corpora and the tables around them."""
