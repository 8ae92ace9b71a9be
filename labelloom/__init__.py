"""Spark-native analytics for curating labelled datasets and auditing predictions made on them."""
