"""Streaming of the architecture catalog."""
