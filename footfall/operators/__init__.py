"""DataFrame -> DataFrame operators (Catalyst expressions, joins,
aggregates, windows)."""
