"""A PySpark-native engine for evidence tables, ranked retrieval and its evaluation."""
