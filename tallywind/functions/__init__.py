"""Column functions: text, dates, similarity."""
