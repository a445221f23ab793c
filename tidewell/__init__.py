"""A PySpark-native historian: time series of (sid, clock, value, quality)."""
