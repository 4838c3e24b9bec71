"""Structured Streaming forms of the feed: ingest, stateful deduplication, windows, updates and rollouts."""
