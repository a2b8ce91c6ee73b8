"""Lodestone: a Spark-native data-quality and entity-resolution engine."""

__version__ = "0.1.0"
