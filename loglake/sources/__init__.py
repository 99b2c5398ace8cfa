"""Readers: JSON events, Kafka, text lines, metrics, SQL rules, stored applications, configuration."""
