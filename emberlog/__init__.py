"""Structured log analytics on Spark: ingest, store, list, count and measure."""
