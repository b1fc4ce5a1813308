"""Generic DataFrame operators: ordered scans, as-of joins, dedupe, sets, aggregates."""
