"""Graph operators: lookups, joins, deduplication, traversals, detectors, views."""
