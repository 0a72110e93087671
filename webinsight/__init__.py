"""PySpark-native analytics for web-commerce operations."""
