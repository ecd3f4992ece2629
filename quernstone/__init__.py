"""A Spark-native learning-analytics engine."""
