"""tesselith: a PySpark-native engine for timestamped text, retrieval and its evaluation."""

__version__ = "0.1.0"
