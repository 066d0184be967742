"""streaming of the lattica engine."""
