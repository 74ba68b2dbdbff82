"""A PySpark-native analytics engine for large collections of short texts."""
