"""Column helpers: numbers and dates."""
