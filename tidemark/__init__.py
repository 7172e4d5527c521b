"""Spark-native analytics for changing the layout of large tables safely."""
