"""Readers and writers of mesh and result files."""
