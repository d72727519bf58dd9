"""Per-row column expressions (built-in Catalyst only, no Python UDF)."""
