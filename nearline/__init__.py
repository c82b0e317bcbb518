"""nearline: Spark-native near-duplicate search and grouping of log records."""

__version__ = "0.1.0"
