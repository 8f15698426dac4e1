"""corpusmill: a PySpark-native engine for building, searching, auditing and evaluating document corpora."""

__version__ = "0.1.0"
