"""Tallyforge: a PySpark-native analytics engine for layered market data."""
