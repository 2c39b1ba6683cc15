"""Phishing-signal preparation, scoring and evaluation as Spark DataFrame operations."""
