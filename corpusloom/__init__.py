"""A PySpark-native engine for document corpora: chunking, fingerprints, overlap, record validation and evaluation."""
