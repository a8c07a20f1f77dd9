"""Structured Streaming jobs (incremental ingest and event-time feeds)."""
