"""Spark-native engine for behaviour and order analytics."""
