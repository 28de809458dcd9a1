"""A Spark-native engine for corpora of query texts."""
