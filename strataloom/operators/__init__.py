"""Operators of the architecture catalog."""
