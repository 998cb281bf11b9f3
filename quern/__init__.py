"""quern: a PySpark-native engine for multilingual document retrieval and corpus processing."""
