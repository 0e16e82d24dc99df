"""functions of the change-analytics engine."""
