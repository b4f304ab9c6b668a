"""Structured Streaming forms of the stateless operators and the run-metric summary."""
