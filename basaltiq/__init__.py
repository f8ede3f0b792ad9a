"""Spark-native analytics over software-engineering data: relations, graphs, logs, text and history."""
