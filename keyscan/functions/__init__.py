"""Column expressions: fixed-width values and sparse integer sets."""
