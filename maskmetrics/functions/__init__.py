"""Column functions on texts and vectors."""
