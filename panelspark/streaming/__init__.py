"""Structured Streaming forms of the snapshot, bar and drift operators."""
