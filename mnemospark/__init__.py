"""Spark jobs over conversational memory: ingest, index, search, rank and fact governance."""
