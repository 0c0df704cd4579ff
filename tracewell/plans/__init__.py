"""plans of the log analytics engine."""
