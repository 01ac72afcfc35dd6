"""lodestar: Spark-native vector search, index integrity and data-pipeline analytics."""
