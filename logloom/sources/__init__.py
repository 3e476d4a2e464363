"""sources of the log engine."""
