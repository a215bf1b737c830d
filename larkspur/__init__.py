"""larkspur: a PySpark-native engine for governed text and JSON training data."""

__version__ = "0.1.0"
