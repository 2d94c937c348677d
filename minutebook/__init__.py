"""minutebook: a PySpark-native retrieval and analytics engine for page-oriented public records."""

__version__ = "0.1.0"
