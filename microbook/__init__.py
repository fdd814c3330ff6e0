"""Spark-native analytics for equity market microstructure around the closing auction."""
