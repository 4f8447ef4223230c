"""Spark-native corpus statistics and bilinear embedding analytics."""
