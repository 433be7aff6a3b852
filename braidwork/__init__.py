"""Spark-native engine for grounded document analytics and corpus processing."""
