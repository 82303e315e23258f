"""Batch and streaming Spark jobs over a literature corpus and its knowledge graph."""
