"""Files, records, catalog metadata and snapshots."""
