"""Table schemas, scans, media listings and sinks."""
