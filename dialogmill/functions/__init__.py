"""Column functions on text and time."""
