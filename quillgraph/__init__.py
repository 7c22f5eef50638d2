"""Spark-native analytics over encyclopedic knowledge: links, categories, concepts, text, views and places."""

__version__ = "0.1.0"
