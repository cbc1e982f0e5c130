"""Column functions: text, numbers, urls."""
