"""Column-level building blocks: projections, text analysis, time, predicates."""
