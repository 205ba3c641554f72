"""attune - a PySpark-native engine for building, cleaning and judging text corpora."""

__version__ = "0.1.0"
