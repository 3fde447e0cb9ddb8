"""Table, record and model sources and sinks."""
