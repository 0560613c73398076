"""A PySpark-native engine for text pseudonymisation and verification."""
