"""Whole jobs composed of operators: one alerting round, retention, batch ingest."""
