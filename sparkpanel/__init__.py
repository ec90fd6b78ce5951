"""Spark-native analytics on panel data: many entities observed over time."""
