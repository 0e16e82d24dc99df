"""sources of the change-analytics engine."""
