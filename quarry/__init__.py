"""A Spark-native analytics engine: a small typed facade over DataFrames and RDDs, with indexed tables."""
