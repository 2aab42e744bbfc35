"""leafmill: a PySpark-native engine for batch document, sheet, page and frame analytics."""

__version__ = "0.1.0"
