"""Spark-native analytics over security findings: sources, detection, merge, scoring, state and reports."""
