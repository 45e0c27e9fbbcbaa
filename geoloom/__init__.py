"""Spatial tables on Spark: catalog, guarded SQL, geographic operators, layers and snapshots."""
