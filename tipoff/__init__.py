"""Spark-native team-and-player analytics engine."""
