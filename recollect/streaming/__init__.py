"""Structured Streaming forms of ingest and of the feedback limiter."""
