"""A PySpark-native engine for layered long-term memory analytics."""
