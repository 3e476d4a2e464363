"""plans of the log engine."""
