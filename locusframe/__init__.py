"""locusframe: a PySpark-native engine for genomic signal and sequence data."""

__version__ = "0.1.0"
