"""A PySpark-native engine for event-sourced market data."""
