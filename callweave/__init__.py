"""callweave: a PySpark-native engine for preparing tool-calling training records."""

__version__ = "0.1.0"
