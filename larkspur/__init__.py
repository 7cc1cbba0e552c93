"""Spark-native analytics over customer reviews and the replies written to them."""
