"""Spark-native toolkit for validating, migrating and curating translated text catalogs."""

__version__ = "0.1.0"
