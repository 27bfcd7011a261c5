"""sarfgrid functions."""
