"""lorewell: a Spark-native engine for knowledge-base analytics."""
