"""Column functions on sequences, identifiers and alignment tags."""
