"""Spark-native behaviour analytics over flow and event data."""
