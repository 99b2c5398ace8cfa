"""Structured Streaming twins: ingest, sliding counts, stateful alerts."""
