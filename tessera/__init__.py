"""Tessera: Spark-native measurement and data-processing operators."""
