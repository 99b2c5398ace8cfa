"""Writers: stored logs, metrics, wire JSON, Kafka, alert history."""
