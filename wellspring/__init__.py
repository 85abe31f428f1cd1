"""A PySpark-native engine for retrieval, evidence ranking and training-data preparation."""
