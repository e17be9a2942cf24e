"""A Spark-native engine for hybrid retrieval, graph analytics and evaluation."""
