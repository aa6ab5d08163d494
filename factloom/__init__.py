"""factloom: Spark-native analytics over long filings and structured facts."""

__version__ = "0.1.0"
