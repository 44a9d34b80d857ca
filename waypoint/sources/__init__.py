"""Sources and sinks: fixture extracts, CSV readers, Parquet cache, CSV sink."""
