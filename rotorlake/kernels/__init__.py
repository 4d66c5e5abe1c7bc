"""Dense linear algebra inside grouped-map tasks."""
