"""Sources, sinks and ingest shaping."""
