"""Column functions on vectors and metadata."""
