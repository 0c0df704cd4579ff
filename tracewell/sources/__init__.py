"""sources of the log analytics engine."""
