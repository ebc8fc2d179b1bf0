"""A Spark-native engine for messy tabular sources and for text corpora."""
