"""sparloom: Spark-native analytics for message-format documents and the data derived from them."""

__version__ = "0.1.0"
