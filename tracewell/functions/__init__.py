"""functions of the log analytics engine."""
