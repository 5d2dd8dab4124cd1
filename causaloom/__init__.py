"""Spark-native analytics over incident reports, causal chains and risk models."""
