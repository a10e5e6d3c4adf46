"""A PySpark-native engine for document corpora: cleaning, chunking, retrieval, evaluation and chat analytics."""
