"""Spark-native extraction and comparison of campaign pages."""
