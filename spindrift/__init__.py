"""Spark-native vector analytics: index tables, search plans, placement ledgers, metrics."""
