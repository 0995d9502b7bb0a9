"""Column functions: text, scores and time."""
