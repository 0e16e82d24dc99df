"""streaming of the change-analytics engine."""
