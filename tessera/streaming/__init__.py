"""Incremental ingestion as Structured Streaming micro-batches."""
