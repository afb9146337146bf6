"""Spark-native interaction analytics and recommendation."""
