"""Operators that prepare text at corpus scale for training language models."""
