"""strandwork: Spark-native cleaning, linkage, panel and time-series analytics."""

__version__ = "0.1.0"
