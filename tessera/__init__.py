"""Tessera: a Spark-native retrieval analytics engine."""
