"""Spark-native analytics for earthquake aftershock sequences."""
