"""Column expressions: text, time, privacy and vectors."""
