"""Column helpers: IEEE arithmetic and text."""
