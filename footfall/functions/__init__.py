"""Column expressions: geometry, the metric grids and tag filters."""
