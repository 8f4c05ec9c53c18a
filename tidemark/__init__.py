"""tidemark: a Spark-native engine for public-opinion time series and text corpora."""

__version__ = "0.1.0"
