"""PySpark-native privacy analytics and text-data engine."""
