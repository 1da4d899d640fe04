"""The incremental form of sync."""
