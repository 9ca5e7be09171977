"""Graph operators: lookup, joins, resolution, maintenance, traversal."""
