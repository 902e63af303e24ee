"""versoflow: Spark-native analytics for large document translation pipelines."""

__version__ = "0.1.0"
