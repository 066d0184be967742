"""plans of the lattica engine."""
