"""Sources of the architecture catalog."""
