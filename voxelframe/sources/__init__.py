"""Sources and sinks: FITS tables, loading by extension, conversion and synthetic data."""
