"""quarry: a PySpark-native engine for web-archive data."""

__version__ = "0.1.0"
