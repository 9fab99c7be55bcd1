"""A Spark-native streaming document engine."""
