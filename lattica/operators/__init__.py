"""operators of the lattica engine."""
