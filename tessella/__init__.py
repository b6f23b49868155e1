"""tessella: a PySpark-native engine for preparing and auditing text corpora."""

__version__ = "0.1.0"
