"""A PySpark-native engine for declared schemas, time series and integrity rules."""
