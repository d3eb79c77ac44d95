"""Text and numeric functions as Column expressions."""
