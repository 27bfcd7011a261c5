"""sarfgrid operators."""
