"""Column expressions: numbers, dates, text and file names."""
