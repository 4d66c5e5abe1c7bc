"""Composite plans: cyclic-symmetry solves, and the registered queries with their SQL."""
