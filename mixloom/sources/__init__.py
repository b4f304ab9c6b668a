"""Readers, catalogue, mixture loading and sinks."""
