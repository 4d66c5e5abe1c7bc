"""Column expressions: complex numbers as pairs, and scalar physics."""
