"""Retrieval evaluation on Spark: evidence units, chunking, ranking, judgments, metrics, pooling and statistics."""
