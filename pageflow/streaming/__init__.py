"""Structured Streaming jobs: ingest, watermark de-dup, visited upsert, event-time counters."""
