"""Spark-native analytics for timelines and the text attached to them."""
