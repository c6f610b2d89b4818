"""Spark-native retrieval, labelling and evaluation analytics."""
