"""operators of the log analytics engine."""
