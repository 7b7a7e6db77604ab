"""Structured Streaming forms of ingest, fold, feeds, retraction and resolution."""
