"""Event logs as streams and as tables."""
