"""docloom: Spark-native analytics over retrieval corpora (documents, chunks, answers, judgements)."""

__version__ = "0.1.0"
