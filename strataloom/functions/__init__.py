"""Functions of the architecture catalog."""
