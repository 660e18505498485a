"""A PySpark-native engine for document corpora: extraction, structuring, indexes, retrieval, graphs and evaluation."""
