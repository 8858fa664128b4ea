"""A Spark-native engine for evidence analytics."""
