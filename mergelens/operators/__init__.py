"""operators of the change-analytics engine."""
