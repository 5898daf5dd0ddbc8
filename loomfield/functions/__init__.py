"""Column functions and helpers that the operators share."""
