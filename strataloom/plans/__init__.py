"""Plans of the architecture catalog."""
