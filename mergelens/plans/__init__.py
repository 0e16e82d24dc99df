"""plans of the change-analytics engine."""
