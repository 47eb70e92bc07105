"""Column expressions: text to time and structure, geography, labels. No Python runs on the executors."""
