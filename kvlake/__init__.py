"""PySpark-native engine for versioned key-value data."""
