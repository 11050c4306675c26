"""Vector search on Spark: exact and approximate nearest neighbours, product quantization, durable ingestion."""

__version__ = "0.1.0"
