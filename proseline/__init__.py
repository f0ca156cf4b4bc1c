"""Spark-native engine for measuring how closely text collections resemble human writing."""
