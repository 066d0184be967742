"""sources of the lattica engine."""
