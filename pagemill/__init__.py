"""pagemill: a Spark-native engine that turns raw text corpora into training-ready samples."""

__version__ = "0.1.0"
