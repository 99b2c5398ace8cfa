"""DataFrame operators: documents, rule evaluation, suppression, routing, collections, metrics, batching."""
