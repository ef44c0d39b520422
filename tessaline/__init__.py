"""A Spark-native engine for key-addressed and append-ordered data."""
