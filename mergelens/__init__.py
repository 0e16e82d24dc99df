"""mergelens: a PySpark-native analytics engine for code changes."""
