"""streaming of the log analytics engine."""
