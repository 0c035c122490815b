"""A Spark-native engine for evidence retrieval, derived charts and text pipelines."""
