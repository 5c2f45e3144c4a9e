"""A Spark-native engine for querying text and workspace facts as DataFrames."""
