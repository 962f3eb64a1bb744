"""Column functions: text and geometry."""
