"""A PySpark-native analytics engine for offline evaluation of candidates."""
